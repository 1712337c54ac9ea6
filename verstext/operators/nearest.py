"""Nearest partners of the sentences of adjacent versions, by arrays inside a task.

Spark deals the sentences by stretches of versions of an entry and sorts them by version; a task reads them in
that order and keeps two versions at a time. A sentence is shuffled once, as the key of its text and the hashes of
its tokens, and the combinations of sentences that share a word live in arrays of a fixed size: they are
neither shuffled nor spilled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from verstext.config import MatchConfig
from verstext.functions import text as tx
from verstext.operators.dealing import deal

STRETCH = 16  # pairs of versions that are dealt together
BATCH_ROWS, BATCH_TOKENS = 50_000, 1_000_000
CELLS, HITS = 1 << 18, 1 << 20


def stretch_of(version: Column) -> Column:
    """Number of the stretch of an older version."""
    return F.shiftright(version + STRETCH // 2, STRETCH.bit_length() - 1).cast("long")


def with_stretches(sentences: DataFrame) -> DataFrame:
    """Sentences with each ``stretch`` of versions they belong to, those of no entry, version or index left out.

    Dealt by entry and stretch, both versions of a pair lie in one task, and an entry with very many
    versions lies in several. Only the first version of a stretch is there twice: it is the newer one of the last pair
    of the stretch before, too.
    """
    keys = ["entry_id", "version", "sent_idx"]
    types = dict(sentences.dtypes)
    # keys that cannot be NULL get no further filters, so all uses of the dealt rows share one exchange
    known = sentences.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)).withColumns(
        {k: F.coalesce(k, F.lit("0").cast(types[k])) for k in keys}
    )
    stretch = stretch_of(F.col("version"))
    first = (F.col("version") + STRETCH // 2).bitwiseAND(STRETCH - 1) == 0
    return known.withColumn("stretch", F.explode(F.when(first, F.array(stretch, stretch - 1)).otherwise(F.array(stretch))))


def nearest_partners_of(sentences: DataFrame, config: MatchConfig, heavy_limit: int) -> DataFrame:
    """The match table of all adjacent versions; ``side`` is NULL in it.

    Pairs of versions with more than ``heavy_limit`` combinations of an open sentence and a possible
    partner are not searched. Their sentences are there once for each side, named by ``side``, with the
    nearest equal sentence of the other side or NULL.
    """
    key = tx.text_key("sentence")
    rows = with_stretches(sentences).select("entry_id", "stretch", "version", "sent_idx", "sentence")
    # texts take less room in a shuffle than the hashes of their tokens
    dealt = deal(rows, ["entry_id", "stretch"], ["version"]).select(
        "entry_id", "stretch", "version", "sent_idx", key["h1"].alias("h1"), key["h2"].alias("h2"), tx.token_hashes("sentence").alias("tokens")
    )
    types = {f.name: f.dataType for f in sentences.schema.fields}
    schema = StructType([
        StructField("entry_id", types["entry_id"]), StructField("version_x", types["version"]), StructField("version_y", types["version"]),
        StructField("sent_idx_x", types["sent_idx"]), StructField("sent_idx_y", types["sent_idx"]),
        StructField("avg_sentence_distance_x", DoubleType()), StructField("avg_sentence_distance_y", DoubleType()),
        StructField("side", StringType()),
    ])

    def work(table: pa.Table, last: bool):
        return _matches(table, last, config, heavy_limit)

    return dealt.mapInArrow(in_pieces(work, {"tokens": BATCH_TOKENS}), schema)


def in_pieces(work: Callable, weights: dict[str, float]) -> Callable:
    """A function over sorted batches that hands ``work`` tables of bounded size.

    ``work(table, last)`` returns batches and the first row that it needs again. ``weights`` names the
    columns of lists or texts and how many of their elements fill a table.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0
        for batch in batches:
            kept.append(batch)
            size += batch.num_rows / BATCH_ROWS
            for name, most in weights.items():
                column = batch.column(name)
                lists = pa.types.is_list(column.type) or pa.types.is_large_list(column.type)
                size += (len(column.flatten()) if lists else column.nbytes) / most
            if size >= 1:
                table = pa.Table.from_batches(kept)
                out, rest = work(table, False)
                kept, size = table.slice(rest).combine_chunks().to_batches(), 0
                yield from out
        if kept:
            yield from work(pa.Table.from_batches(kept), True)[0]

    return run


class Versions:
    """Where the versions of a sorted table begin, and which of them have their next version in it."""

    def __init__(self, table: pa.Table, last: bool):
        entry = codes(table.column("entry_id"))
        stretch, version = (table.column(c).to_numpy().astype(np.int64) for c in ("stretch", "version"))
        self.begins = np.r_[0, np.flatnonzero((np.diff(entry) != 0) | (np.diff(stretch) != 0) | (np.diff(version) != 0)) + 1]
        self.lengths = np.diff(np.r_[self.begins, table.num_rows])
        at = entry[self.begins], stretch[self.begins], version[self.begins]
        follows = (np.diff(at[0]) == 0) & (np.diff(at[1]) == 0) & (np.diff(at[2]) == 1)
        # the last version may go on in the next batch, and the one before it is its older one
        again = -2 if len(self.begins) > 1 and follows[-1] else -1
        self.rest = table.num_rows if last else int(self.begins[again])
        self.older = np.flatnonzero(follows if last else follows[:-1])


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers ``start, start + 1, ...`` of all ranges in turn."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def codes(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


class _Rows:
    """Arrays of the sentences of one table, sorted by entry, stretch and version."""

    def __init__(self, table: pa.Table):
        lists = table.column("tokens").combine_chunks()
        self.size = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.word = codes(lists.flatten())
        self.words = int(self.word.max()) + 1 if len(self.word) else 1
        # the distinct words of each sentence
        each = np.sort(np.repeat(np.arange(len(self.size)), self.size) * self.words + self.word)
        each = each[np.r_[True, np.diff(each) != 0][: len(each)]]
        self.bag = each % self.words
        self.bag_size = np.bincount(each // self.words, minlength=len(self.size))
        self.bag_start = np.cumsum(self.bag_size) - self.bag_size
        h1, h2 = (table.column(c).to_numpy() for c in ("h1", "h2"))
        order = np.lexsort((h2, h1))
        fresh = np.r_[False, (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])] if len(order) else []
        self.text = np.empty(len(order), np.int64)
        self.text[order] = np.cumsum(fresh)
        # places count from 1; 0 stands for no place
        values = table.column("sent_idx").to_numpy().astype(np.int64)
        self.least = int(values.min())
        self.place = values - self.least + 1
        self.span = int(self.place.max()) + 2


class Side:
    """The sentences of one side of the pairs: their rows and their pairs."""

    def __init__(self, rows: Any, first: np.ndarray, lengths: np.ndarray):
        self.row = ranges(first, lengths)
        self.pair = np.repeat(np.arange(len(first)), lengths)
        self.place = rows.place[self.row]
        self.key = self.pair * rows.span + self.place


def _exact(rows: _Rows, own: Side, other: Side) -> np.ndarray:
    """Place of the nearest equal sentence of the other side, the lower one of two; 0 if there is none."""
    texts = int(rows.text.max()) + 1
    both = np.concatenate([own.pair * texts + rows.text[own.row], other.pair * texts + rows.text[other.row]])
    code = np.unique(both, return_inverse=True)[1]
    mine, theirs = code[: len(own.row)], code[len(own.row):]
    there = np.sort((theirs * rows.span + other.place)[other.place > 0])
    if not len(there):
        return np.zeros(len(own.row), np.int64)
    at = mine * rows.span + own.place
    below, above = np.searchsorted(there, at, "right") - 1, np.searchsorted(there, at, "left")
    found = []
    for spot in (below, above):
        hit = there[np.clip(spot, 0, len(there) - 1)]
        fits = (spot >= 0) & (spot < len(there)) & (hit // rows.span == mine)
        found.append(np.where(fits, hit % rows.span, 0))
    before, after = found
    nearer = (after == 0) | ((before > 0) & (own.place - before <= after - own.place))
    return np.where(nearer, before, after)


def _rounded(matched: np.ndarray, n: np.ndarray, config: MatchConfig) -> np.ndarray:
    """The distance as Spark rounds it, half up on the decimal digits of the number."""
    pairs, back = np.unique(np.stack([matched, n]), axis=1, return_inverse=True)
    unit = Decimal(1).scaleb(-config.digits)
    values = [(config.word_cutoff * (int(b) - int(a))) / int(b) for a, b in pairs.T]
    rounded = [float(Decimal(repr(v)).quantize(unit, ROUND_HALF_UP)) for v in values]
    return np.array(rounded, np.float64)[back.reshape(-1)]


def _search(rows: _Rows, own: Side, other: Side, opened: np.ndarray, searched: np.ndarray, config: MatchConfig):
    """Partner and distance of the opened sentences of the searched pairs, by row of ``own``; partner 0 if there is none.

    Rows that share their place share its words: the words of such rows add up.
    """
    partner, distance = np.zeros(len(own.row), np.int64), np.full(len(own.row), np.nan)
    keys, key_of = np.unique(own.key, return_inverse=True)
    weight = np.bincount(key_of[opened & searched[own.pair] & (own.place > 0)], minlength=len(keys))
    n = np.zeros(len(keys), np.int64)
    np.maximum.at(n, key_of, rows.size[own.row])
    usable = other.place > 0
    targets, target_of = np.unique(other.key[usable], return_inverse=True)
    target_pair = targets // rows.span
    pairs = len(searched)
    first = np.searchsorted(target_pair, np.arange(pairs))
    width = np.bincount(target_pair, minlength=pairs)
    key_pair = keys // rows.span
    wanted = np.flatnonzero((weight > 0) & (n > 0) & (width[key_pair] > 0))
    if not len(wanted):
        return partner, distance
    # words of the possible partners, sorted by pair and word
    held = searched[other.pair[usable]]
    their = other.row[usable][held]
    count = rows.bag_size[their]
    posting = np.repeat(other.pair[usable][held], count) * rows.words + rows.bag[ranges(rows.bag_start[their], count)]
    order = np.argsort(posting, kind="stable")
    posting = posting[order]
    posted = (target_of - first[other.pair[usable]])[held].repeat(count)[order]
    # words of the searching sentences, by sentence
    number = np.full(len(keys), -1)
    number[wanted] = np.arange(len(wanted))
    mine = np.flatnonzero(number[key_of] >= 0)
    mine = mine[np.argsort(number[key_of[mine]], kind="stable")]
    count = rows.size[own.row[mine]]
    owner = np.repeat(number[key_of[mine]], count)
    word = np.repeat(own.pair[mine], count) * rows.words + rows.word[ranges(rows.start[own.row[mine]], count)]
    low = np.searchsorted(posting, word, "left")
    hits = np.searchsorted(posting, word, "right") - low
    met = hits > 0
    owner, low, hits = owner[met], low[met], hits[met]
    hit_ends = np.cumsum(hits)
    widths = width[key_pair[wanted]]
    ends = np.cumsum(widths)
    best_place, best_matched = np.zeros(len(wanted), np.int64), np.zeros(len(wanted), np.int64)
    a = 0
    while a < len(wanted):
        done = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, done + CELLS, "right")))
        matched = np.zeros(ends[b - 1] - done, np.int64)
        t, stop = np.searchsorted(owner, [a, b])
        while t < stop:
            before = hit_ends[t - 1] if t else 0
            u = min(stop, max(t + 1, int(np.searchsorted(hit_ends, before + HITS, "right"))))
            cells = np.repeat((ends - widths)[owner[t:u]] - done, hits[t:u]) + posted[ranges(low[t:u], hits[t:u])]
            matched += np.bincount(cells, minlength=len(matched))
            t = u
        size, part = widths[a:b], wanted[a:b]
        begin = ends[a:b] - size - done
        total = np.repeat(n[part], size)
        matched *= np.repeat(weight[part], size)
        steps = np.floor(config.word_cutoff * (total - matched) / total * 10**config.digits + 0.5)
        steps[matched == 0] = np.inf
        place = targets[ranges(first[key_pair[part]], size)] % rows.span
        gap = np.abs(place - np.repeat(keys[part] % rows.span, size))
        tie = steps == np.repeat(np.minimum.reduceat(steps, begin), size)
        gap[~tie] = rows.span
        tie &= gap == np.repeat(np.minimum.reduceat(gap, begin), size)
        at = np.minimum.reduceat(np.where(tie, np.arange(len(tie)), len(tie)), begin)
        best_matched[a:b] = matched[at]
        best_place[a:b] = np.where(matched[at] > 0, place[at], 0)
        a = b
    scored = _rounded(best_matched, n[wanted], config)
    close = (best_place > 0) & (scored < config.sentence_threshold)
    mine = np.flatnonzero(opened & (number[key_of] >= 0))
    nth = number[key_of[mine]]
    partner[mine] = np.where(close, best_place, 0)[nth]
    distance[mine] = np.where(close, scored, np.nan)[nth]
    return partner, distance


def _matches(table: pa.Table, last: bool, config: MatchConfig, heavy_limit: int):
    """Batches of the match table of the pairs whose versions are complete, and the first row still needed."""
    if table.num_rows == 0:
        return [], 0
    versions = Versions(table, last)
    begins, lengths, older, rest = versions.begins, versions.lengths, versions.older, versions.rest
    if not len(older):
        return [], rest
    rows = _Rows(table)
    x, y = Side(rows, begins[older], lengths[older]), Side(rows, begins[older + 1], lengths[older + 1])
    exact = {"x": _exact(rows, x, y), "y": _exact(rows, y, x)}
    pairs = len(older)
    open_x, open_y = (np.bincount(s.pair[exact[name] == 0], minlength=pairs) for name, s in (("x", x), ("y", y)))
    work = np.maximum(open_x * lengths[older + 1], open_y * lengths[older])
    light = work <= heavy_limit
    found = {}
    for name, own, other in (("x", x, y), ("y", y, x)):
        partner, distance = _search(rows, own, other, exact[name] == 0, light, config)
        settled = exact[name] > 0
        found[name] = np.where(settled, exact[name], partner), np.where(settled, 0.0, distance)
    out = []
    keep = {name: light[s.pair] for name, s in (("x", x), ("y", y))}
    pair = np.concatenate([x.pair[keep["x"]], y.pair[keep["y"]]])
    place_x = np.concatenate([x.place[keep["x"]], found["y"][0][keep["y"]]])
    place_y = np.concatenate([found["x"][0][keep["x"]], y.place[keep["y"]]])
    none_x, none_y = (np.full(int(keep[name].sum()), np.nan) for name in "xy")
    distance_x = np.concatenate([found["x"][1][keep["x"]], none_y])
    distance_y = np.concatenate([none_x, found["y"][1][keep["y"]]])
    if len(pair):
        # a pair found from both sides becomes one row
        order = np.lexsort((place_y, place_x, pair))
        pair, place_x, place_y = pair[order], place_x[order], place_y[order]
        head = np.flatnonzero(np.r_[True, (np.diff(pair) != 0) | (np.diff(place_x) != 0) | (np.diff(place_y) != 0)])
        merged = [np.fmax.reduceat(d[order], head) for d in (distance_x, distance_y)]
        out.append((pair[head], place_x[head], place_y[head], *merged, None))
    for name, s in (("x", x), ("y", y)):
        heavy = ~keep[name]
        if heavy.any():
            own, partner = s.place[heavy], exact[name][heavy]
            places = (own, partner) if name == "x" else (partner, own)
            none = np.full(len(own), np.nan)
            out.append((s.pair[heavy], *places, none, none, name))
    return [_batch(table, rows, begins[older], *part) for part in out], rest


def _batch(table, rows, first, pair, place_x, place_y, distance_x, distance_y, side) -> pa.RecordBatch:
    at = pa.array(first[pair])
    version = table.column("version").take(at).combine_chunks()
    kinds = table.schema.field("version").type, table.schema.field("sent_idx").type
    newer = pa.array(version.to_numpy(zero_copy_only=False) + 1).cast(kinds[0])
    places = [pa.array(p + rows.least - 1, mask=p == 0).cast(kinds[1]) for p in (place_x, place_y)]
    distances = [pa.array(d, mask=np.isnan(d)) for d in (distance_x, distance_y)]
    names = ["entry_id", "version_x", "version_y", "sent_idx_x", "sent_idx_y", "avg_sentence_distance_x", "avg_sentence_distance_y", "side"]
    columns = [table.column("entry_id").take(at).combine_chunks(), version, newer, *places, *distances, pa.array([side] * len(pair), pa.string())]
    return pa.RecordBatch.from_arrays(columns, names)
