"""Benchmark decontamination by templates: matches survive changed numbers, names and units.

A token becomes a typed placeholder if it is a number, a capitalised word or a unit. Windows of
template tokens are joined by hash between documents and benchmark items. A run of matching
windows on one diagonal is a possible leak; it counts if every placeholder value of the item
corresponds to one value of the document and the other way round, so a question with other names
and numbers is caught and a chance meeting of two patterns of placeholders is not.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from verstext.llm.rows import keep_rows, map_keyed, once_per_worker

# fixed values: units that become placeholders
UNITS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces pound pounds lb lbs ton tons "
    "ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years "
    "cent cents dollar dollars euro euros percent degree degrees meter meters metre metres kilometer kilometers kph mph".split()
)
# fixed values: numbers in words
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split()
)
NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*%?\Z")
EDGES = " \t\r\n\x0b\x0c.,;:!?\"'()[]{}<>|*_"
MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class LeakConfig:
    """A leak is a consistent run of ``least_tokens`` tokens, or of the whole item if it is shorter.

    ``literal_share`` of a run must be words rather than placeholders. ``block_chars`` bounds the
    benchmark text that is held at once; a larger benchmark is gone through in blocks.
    """

    window: int = 8
    least_tokens: int = 13
    literal_share: float = 0.3
    block_chars: int = 16_000_000


def canonical(token: str) -> tuple[str, str]:
    """(template token, slot value); the value is empty for a word that stays as it is."""
    if token.isalpha() and token == token.lower() and not token[0].isupper() and token not in NUMBER_WORDS and token not in UNITS:
        return token, ""  # most tokens
    bare = token.strip(EDGES)
    if not bare:
        return "", ""
    low = bare.lower()
    if NUMBER.match(bare) or low in NUMBER_WORDS:
        return "\x00number", low
    if low in UNITS:
        return "\x00unit", low
    if bare[0].isupper():
        return "\x00name", low
    return low, ""


@dataclass(frozen=True)
class View:
    """One reading of a text, token by token, as 64-bit hashes.

    ``forms``: the template token. ``words``: the same with a name as its lower-case word, so that a
    word agrees with its capitalised form. ``values``: the slot value (0: no slot). ``ends``: tokens
    of the text up to each one, which a folded token counts with all its tokens.
    """

    forms: np.ndarray
    words: np.ndarray
    values: np.ndarray
    ends: np.ndarray

    def __len__(self) -> int:
        return len(self.forms)


class Powers:
    """Powers of an odd number and of its inverse modulo 2 ** 64, as many as were asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            n = max(n, 2 * len(self.up))
            self.up, self.down = (
                np.concatenate(([np.uint64(1)], np.cumprod(np.full(n - 1, base, dtype=np.uint64)))) for base in (MIX, np.uint64(pow(int(MIX), -1, 1 << 64)))
            )
        return self.up, self.down


POWERS = Powers()


def stretch_hashes(column: np.ndarray, starts: np.ndarray | slice, stops: np.ndarray | slice) -> np.ndarray:
    """Order-dependent hashes of stretches of a column of hashes, from running sums."""
    up, down = POWERS.upto(len(column) + 1)
    total = np.zeros(len(column) + 1, dtype=np.uint64)
    np.cumsum(column * up[: len(column)], out=total[1:])
    return (total[stops] - total[starts]) * down[: len(column) + 1][starts]


class Known(dict):
    """Numbers of tokens in the order in which they were met; ``rows`` has four hashes of each."""

    NAME, FORMS = "\x00name", {f: xxhash.xxh64_intdigest(f) for f in ("\x00name", "\x00number", "\x00unit")}

    def __init__(self):
        super().__init__()
        self.rows = array("Q")  # form, word, value, kind to fold (0: none)

    def __missing__(self, token: str) -> int:
        form, value = canonical(token)
        if not value:
            low = xxhash.xxh64_intdigest(form) if form else 0
            word = form.casefold()
            row = low, low if word == form else xxhash.xxh64_intdigest(word), 0, 0
        else:
            hashed = xxhash.xxh64_intdigest(value)
            named = form == self.NAME
            word = (hashed if named and value.casefold() == value else xxhash.xxh64_intdigest(value.casefold())) if named else self.FORMS[form]
            row = self.FORMS[form], word, (hashed ^ self.FORMS[form]) | 1, 1 if named else 2 if value in NUMBER_WORDS else 0
        self.rows.extend(row)
        at = self[token] = len(self)
        return at


class Tokens:
    """Texts as views: token by token, and with neighbouring names or number words as one token."""

    def __init__(self, limit: int = 500_000):
        self.known = Known()
        self.limit = limit

    def read(self, text: str) -> tuple[View, View | None]:
        """The views of a text; the second is None where nothing is folded."""
        tokens = text.split()
        if len(self.known) > self.limit:
            self.known = Known()
        at = np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))
        rows = np.frombuffer(self.known.rows, np.uint64).reshape(-1, 4)[at] if len(at) else np.zeros((0, 4), np.uint64)
        forms, words, values, kinds = np.ascontiguousarray(rows[rows[:, 0] != 0].T)  # tokens of punctuation alone are no tokens
        plain = View(forms, words, values, np.arange(1, len(forms) + 1))
        inner = np.zeros(len(forms), dtype=bool)
        inner[1:] = (kinds[1:] != 0) & (kinds[1:] == kinds[:-1])
        if not inner.any():
            return plain, None
        heads = np.flatnonzero(~inner)
        ends = np.append(heads[1:], len(forms))
        long = ends - heads > 1
        words, values = (
            np.where(long & chosen, stretch_hashes(column, heads, ends) | np.uint64(1), column[heads])
            for column, chosen in ((words, kinds[heads] == 1), (values, True))
        )
        return plain, View(forms[heads], words, values, ends)


def window_hashes(forms: np.ndarray, size: int) -> np.ndarray:
    """Order-dependent hash of every window of ``size`` tokens."""
    n = len(forms) - size + 1
    return stretch_hashes(forms, slice(0, n), slice(size, None)) if n > 0 else forms[:0]


class Windows:
    """The windows of one reading of the items, sorted by hash, for each window length.

    A window with a literal is joined by its template. One of placeholders alone says nothing but its
    values: a part without literals counts only if no slot has changed, and a longer part has a window
    with a literal. So these are joined by their values, or any two tables of numbers would meet everywhere.
    """

    def __init__(self, config: LeakConfig, by_word: bool):
        self.config, self.by_word = config, by_word
        self.parts: dict[tuple[int, bool], list[np.ndarray]] = {}
        self.sizes: dict[int, dict[bool, np.ndarray]] = {}  # by size, and whether of placeholders alone
        self.marks: dict[tuple[int, bool], np.ndarray] = {}

    def column(self, view: View) -> np.ndarray:
        return view.words if self.by_word else view.forms

    def alone(self, view: View, size: int) -> np.ndarray:
        """Which windows are placeholders alone; read by words, a name is a literal."""
        literal = view.values == 0
        if self.by_word:
            literal |= view.words != view.forms
        count = np.concatenate(([0], np.cumsum(literal)))
        return count[size:] == count[:-size]

    def add(self, item: int, view: View) -> None:
        size = min(self.config.window, len(view))
        alone = self.alone(view, size)
        for kind, column in ((False, self.column(view)), (True, view.values)):
            at = np.flatnonzero(alone == kind)
            if len(at):
                entry = np.zeros(len(at), dtype=[("hash", "u8"), ("item", "i8"), ("at", "i8")])
                entry["hash"], entry["item"], entry["at"] = window_hashes(column, size)[at], item, at
                self.parts.setdefault((size, kind), []).append(entry)

    def close(self) -> None:
        for (size, kind), parts in self.parts.items():
            entries = np.sort(np.concatenate(parts), order="hash")
            self.sizes.setdefault(size, {})[kind] = entries
            mark = self.marks[size, kind] = np.zeros(1 << 18, dtype=bool)
            mark[entries["hash"] >> np.uint64(46)] = True
        self.parts.clear()

    def hits(self, view: View, size: int, kind: bool) -> tuple[np.ndarray, np.ndarray]:
        """(place in the document, window of an item) of equal windows of one kind."""
        entries, mark = self.sizes[size][kind], self.marks[size, kind]
        here = window_hashes(view.values if kind else self.column(view), size)
        found = mark[here >> np.uint64(46)]
        if kind and found.any():
            found &= self.alone(view, size)
        where = np.flatnonzero(found)
        if not len(where):
            return where, entries[:0]
        here = here[where]
        low = np.searchsorted(entries["hash"], here, "left")
        sizes = np.searchsorted(entries["hash"], here, "right") - low
        inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return np.repeat(where, sizes), entries[np.repeat(low, sizes) + inside]

    def runs(self, view: View):
        """(item, start, stop, start in the document) of the runs of windows on one diagonal."""
        for size, kinds in self.sizes.items():
            found = [self.hits(view, size, kind) for kind in kinds]
            at, entry = found[0] if len(found) == 1 else (np.concatenate(c) for c in zip(*found, strict=True))
            if not len(at):
                continue
            order = np.lexsort((entry["at"], at - entry["at"], entry["item"]))
            at, entry = at[order], entry[order]
            starts = np.flatnonzero(np.concatenate((
                [True], (entry["item"][1:] != entry["item"][:-1]) | (np.diff(at - entry["at"]) != 0) | (np.diff(entry["at"]) > size),
            )))
            for s, e in zip(starts, np.append(starts[1:], len(at)), strict=True):
                yield int(entry["item"][s]), int(entry["at"][s]), int(entry["at"][e - 1]) + size, int(at[s])


class ItemIndex:
    """The windows of a block of benchmark items. Short items are one window.

    Documents are searched by templates, by templates with names as words, and by both again with
    neighbours folded; a run may hold tokens that agree either way.
    """

    def __init__(self, items: list[tuple[int, str]], config: LeakConfig):
        tokens = Tokens()
        self.config, self.items = config, []
        self.windows = [[Windows(config, by_word) for by_word in (False, True)] for _ in range(2)]  # [folded][words]
        for item_id, text in items:
            plain, folded = tokens.read(text)
            if not len(plain):
                continue
            views = (plain, folded or plain)
            for view, (by_form, by_word) in zip(views, self.windows, strict=True):
                if len(view) < min(config.window, len(plain)):
                    continue  # folded to less than a window: too little to tell items apart
                by_form.add(len(self.items), view)
                by_word.add(len(self.items), view)
            self.items.append((item_id, views))
        for windows in (w for pair in self.windows for w in pair):
            windows.close()

    def leaks(self, plain: View, folded: View | None) -> list[tuple]:
        """(item_id, tokens, item tokens, slots, changed slots) of the best run for each leaked item."""
        best: dict[int, tuple] = {}
        for f, view in enumerate((plain, folded or plain)):
            seen = set()
            for windows in self.windows[f]:
                for found in windows.runs(view):
                    if found in seen:
                        continue
                    seen.add(found)
                    item, start, stop, at = found
                    run = self.run(item, start, stop, at, self.items[item][1][f], view)
                    if run and (item not in best or run[1:] > best[item][1:]):
                        best[item] = run
        return list(best.values())

    def run(self, item: int, start: int, stop: int, at: int, there_view: View, here_view: View):
        """The longest consistent part of a matching run, or None if it is too short.

        Tokens between two windows of the run may differ; such a token ends a part. Where a slot value
        would correspond to two values, the part goes on behind the last slot that says otherwise.
        """
        def agree(a: int, b: int) -> np.ndarray:
            here = slice(a + shift, b + shift)
            return (there_view.forms[a:b] == here_view.forms[here]) | (there_view.words[a:b] == here_view.words[here])

        shift, step = at - start, 4 * self.config.window
        while start > max(0, -shift):  # tokens beside the windows may agree the other way
            low = max(0, -shift, start - step)
            part = agree(low, start)
            start = low if part.all() else low + int(np.flatnonzero(~part)[-1]) + 1
            if start > low:
                break
        limit = min(len(there_view), len(here_view) - shift)
        while stop < limit:
            high = min(limit, stop + step)
            part = agree(stop, high)
            stop = high if part.all() else stop + int(np.argmin(part))
            if stop < high:
                break
        same = agree(start, stop).tolist()
        theirs = there_view.values[start:stop]
        as_words = there_view.words[start:stop] == here_view.words[start + shift : stop + shift]
        as_words &= there_view.words[start:stop] != there_view.forms[start:stop]  # numbers and units have no word of their own
        mine = np.where((theirs == 0) | as_words, theirs, here_view.values[start + shift : stop + shift])
        slots = np.concatenate(([0], np.cumsum(theirs != 0)))
        changed = np.concatenate(([0], np.cumsum(mine != theirs)))
        ends = [there_view.ends[start - 1] if start else 0, *there_view.ends[start:stop]]
        best, longest = None, min(self.config.least_tokens, len(there_view)) - 1
        there: dict[int, tuple[int, int]] = {}  # a value of the item: the document's value and the last place of the two
        back: dict[int, tuple[int, int]] = {}
        first = 0  # the earliest start of a consistent part up to k
        for k, (agrees, x, y) in enumerate(zip(same, theirs.tolist(), mine.tolist(), strict=True)):
            if not agrees:
                first = k + 1
                continue
            if x:
                for (other, place), value in ((there.get(x, (y, 0)), y), (back.get(y, (x, 0)), x)):
                    if other != value:
                        first = max(first, place + 1)
                there[x], back[y] = (y, k), (x, k)
            if k + 1 - first > longest:
                i = self.earliest(first, k + 1 - longest, k + 1, slots, changed)
                if i is not None:
                    longest = k + 1 - i
                    counts = ends[k + 1] - ends[i], len(self.items[item][1][0]), slots[k + 1] - slots[i], changed[k + 1] - changed[i]
                    best = (self.items[item][0], *map(int, counts))
        return best

    def earliest(self, first: int, last: int, stop: int, slots: np.ndarray, changed: np.ndarray) -> int | None:
        """The earliest start before ``last`` of a part that has enough words, or no changed slot."""
        for end in (first + 1, last):  # the longest part alone is nearly always enough
            i = np.arange(first, end)
            fits = (stop - i - (slots[stop] - slots[i]) >= self.config.literal_share * (stop - i)) | (changed[stop] == changed[i])
            if fits.any():
                return first + int(np.argmax(fits))
        return None


def leaks(docs: DataFrame, benchmark: DataFrame, config: LeakConfig = LeakConfig(), key: str = "doc_id", text: str = "text",
          item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, item_id, n_tokens, item_tokens, n_slots, n_changed``: one row for each leak.

    ``n_tokens`` is the longest consistent run of the item in the document, ``n_changed`` counts its
    placeholders with other values (0: verbatim). NULL and empty texts and items leak nothing; rows
    with a NULL key are reported with it, repeated rows once each. Whole texts are searched. The
    benchmark is held by each task in blocks of at most ``block_chars`` characters (a longer item is
    a block of its own); every block meets all documents, whatever their number. No shuffle.
    """
    item_kind = benchmark.schema[item_key].dataType.simpleString()
    fields = f"{item_key} {item_kind}, n_tokens long, item_tokens long, n_slots long, n_changed long"
    rows = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text"))

    def search(block: list[tuple[int, str]]):
        searcher = start_search(docs, block, config)

        def start():
            leaks_of = searcher()

            def find(texts: list[str]):
                found = [(i, *leak) for i, t in enumerate(texts) for leak in leaks_of(t)]
                columns = [list(c) for c in zip(*found, strict=True)] or [[]] * 6
                return columns[0], columns[1:]

            return find

        return map_keyed(rows, start, fields)

    return reduce(DataFrame.unionAll, map(search, item_blocks(benchmark, config, item_key, item_text)))


def item_blocks(benchmark: DataFrame, config: LeakConfig, item_key: str, item_text: str) -> Iterator[list[tuple[int, str]]]:
    items = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item_key).alias("item"), F.col(item_text).alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = -(-chars // config.block_chars) or 1
    for b in range(n_blocks):
        block = items.where(F.pmod(F.xxhash64("text"), F.lit(n_blocks)) == b).orderBy("item", "text").collect()
        yield [(r["item"], r["text"]) for r in block]


def start_search(docs: DataFrame, block: list[tuple[int, str]], config: LeakConfig):
    """A start function for a task; what it returns gives the leaks of one text.

    A Python worker builds the index once and keeps it for its later tasks.
    """
    shared, name = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

    def start():
        index, tokens = once_per_worker(name, lambda: (ItemIndex(shared.value, config), Tokens()))
        return lambda text: index.leaks(*tokens.read(text))

    return start


def drop_leaks(docs: DataFrame, benchmark: DataFrame, config: LeakConfig = LeakConfig(), text: str = "text",
               item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents without a leak, all columns kept; each row is judged by its own text, whatever its key."""
    for block in item_blocks(benchmark, config, item_key, item_text):
        searcher = start_search(docs, block, config)

        def judge(searcher=searcher):
            leaks_of = searcher()
            return lambda texts: [not leaks_of(t) for t in texts]

        docs = keep_rows(docs, judge, text)
    return docs
