"""Removal of repeated byte strings with a run-length index of the repetitive parts of a corpus.

1. *Anchors.* In every ``length``-byte string the ``seed``-byte string with the smallest hash is an
   anchor. Equal strings have equal anchors at equal places, so only texts around an anchor that
   several documents have can hold a repeat. Anchors are dealt by hash; the text on both around of
   an anchor that the strings with this anchor can reach is its segment.
2. *Classes.* Occurrences with equal segments form a class, which the smallest document stands for:
   all strings of the other members are repeats. A string that holds the anchor reaches some bytes
   to its left and the rest to its right, so a class shares a string with another only if they agree
   on one of four stretches about the anchor (``contexts``). Only such classes need their text.
3. *Run-length index.* The segments of these classes are indexed by a Burrows-Wheeler transform,
   stored as runs with samples at the run ends, sorted to a depth of ``length`` bytes and by
   document among equal strings. Runs are also cut where a string of several documents begins, so the
   sample there names its smallest document.
4. *Matching statistics.* Every segment is streamed backwards through the index, from the rows of its last
   string on: a step follows the runs of one byte, and the match is held to ``length`` bytes. A string is a repeat
   if the sample at its first row is a smaller document.
5. The marks of a document go back to its text, which is read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from verstext.llm.rows import map_keyed
from verstext.runtime import materialise

PART_ANCHORS = 300_000
PART_SEGMENTS = 4_000
PIECE_BYTES = 8_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
MIX = np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class RepeatConfig:
    length: int = 50
    seed: int = 16

    @property
    def reach(self) -> int:
        """Places of the anchor inside a string, and bytes of a segment on each side of it, plus one."""
        return self.length - self.seed + 1

    @property
    def contexts(self) -> list[tuple[int, int]]:
        """(left, right) bytes about an anchor: every string that holds the anchor covers one of the four."""
        bounds = [self.reach * q // 4 for q in range(5)]
        return [(low, self.length - self.seed - (high - 1)) for low, high in zip(bounds, bounds[1:], strict=False)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


class Hasher:
    """Hashes of ranges of bytes from prefix sums of byte values times powers of an odd base."""

    def __init__(self):
        rng = np.random.default_rng(2024)
        self.values = rng.integers(1, 2**63, (2, 256), dtype=np.uint64)
        self.inverse = np.ones(1, dtype=np.uint64)
        self.power = np.ones(1, dtype=np.uint64)

    def grow(self, n: int) -> None:
        if len(self.power) < n:
            size = max(n, 2 * len(self.power), 1 << 16)
            self.power = np.concatenate(([np.uint64(1)], np.cumprod(np.full(size, BASE))))
            self.inverse = np.concatenate(([np.uint64(1)], np.cumprod(np.full(size, INVERSE))))

    def prefix(self, text: np.ndarray, table: int) -> np.ndarray:
        self.grow(len(text) + 1)
        sums = np.zeros(len(text) + 1, dtype=np.uint64)
        np.cumsum(self.values[table][text] * self.power[: len(text)], out=sums[1:])
        return sums

    def ranges(self, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (sums[stop] - sums[start]) * self.inverse[start]


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of every ``width`` neighbours."""
    span = 1
    while 2 * span <= width:
        values = pick(values[:-span], values[span:])
        span *= 2
    return pick(values[: len(values) - (width - span)], values[width - span :]) if span < width else values


def find_anchors(text: bytes, hasher: Hasher, config: RepeatConfig):
    """(place, anchor hash, segment hash, four context hashes in one number) of the anchors of a text.

    0 stands for a context that does not fit into the text.
    """
    n, reach = len(text), config.reach
    if n < config.length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    data = np.frombuffer(text, dtype=np.uint8)
    sums = hasher.prefix(data, 0)
    seeds = n - config.seed + 1
    hashes = mixed((sums[config.seed :] - sums[:seeds]) * hasher.inverse[:seeds]) | np.uint64(1)
    lowest = sliding(hashes, reach, np.minimum)  # of each string of ``length`` bytes
    padded = np.zeros(len(lowest) + 2 * (reach - 1), dtype=np.uint64)
    padded[reach - 1 : reach - 1 + len(lowest)] = lowest
    places = np.flatnonzero(sliding(padded, reach, np.maximum) == hashes)
    start, stop = np.maximum(places - (reach - 1), 0), np.minimum(places + config.length, n)
    segment = hasher.ranges(hasher.prefix(data, 1), start, stop)
    segment = mixed(segment + mixed(((places - start) * 64 + (stop - places)).astype(np.uint64)))
    around = np.zeros(len(places), dtype=np.uint64)
    for i, (left, right) in enumerate(config.contexts):
        begin, end = np.maximum(places - left, 0), np.minimum(places + config.seed + right, n)
        context = mixed(hasher.ranges(sums, begin, end)) >> np.uint64(48) | np.uint64(1)
        context[end - begin < config.seed + left + right] = 0
        around |= context << np.uint64(16 * i)
    return places, hashes[places], segment, around


def pack_marks(docs: np.ndarray, tags: np.ndarray, at: np.ndarray, more: np.ndarray) -> list[tuple]:
    """One (document, tag of its text, places, values) row for each text of a document."""
    order = np.lexsort((at, tags, docs))
    docs, tags, at, more = docs[order], tags[order], at[order], more[order]
    cut = np.flatnonzero(np.concatenate(([True], (docs[1:] != docs[:-1]) | (tags[1:] != tags[:-1])))) if len(docs) else np.zeros(0, np.int64)
    return [(int(docs[s]), int(tags[s]), at[s:e].astype("<u4").tobytes(), more[s:e].astype("<u8").tobytes()) for s, e in zip(cut, np.append(cut[1:], len(docs)), strict=False)]


def anchor_pieces(rows: DataFrame, parts: int, config: RepeatConfig) -> DataFrame:
    """The anchors of a piece of the documents that go to one part, packed column by column.

    Of a class that a piece has several times only the smallest document goes on; the others are
    repeats already. Their marks (``repeat_*``) travel with one of the rows of the piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        held: list[tuple[int, int, tuple]] = []
        size = 0

        def out() -> pa.RecordBatch:
            held.sort(key=lambda h: h[0])  # the anchors are in the order of documents and places now
            ids, tags = (np.array([h[i] for h in held], dtype=np.int64) for i in range(2))
            number = np.repeat(np.arange(len(held)), [len(a[0]) for *_, a in held])
            at, hashes, segments, around = (np.concatenate([a[i] for *_, a in held]) for i in range(4))
            part = (hashes >> np.uint64(16)) % np.uint64(parts)
            order = np.lexsort((segments, hashes, part))
            at, hashes, segments, around, number, part = (x[order] for x in (at, hashes, segments, around, number, part))
            keys = ids[number]
            new = np.ones(len(at), dtype=bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (segments[1:] != segments[:-1])
            smallest = np.repeat(keys[new], np.diff(np.append(np.flatnonzero(new), len(at)))) if len(at) else keys
            again = keys > smallest
            marks = pack_marks(keys[again], tags[number[again]], at[again], np.full(int(again.sum()), FULL))
            at, hashes, segments, around, number, part = (x[~again] for x in (at, hashes, segments, around, number, part))
            cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.zeros(0, np.int64)
            made = []
            for s, e in zip(cut, np.append(cut[1:], len(part)), strict=False):
                own, place = np.unique(number[s:e], return_inverse=True)
                packed = (ids[own], tags[own], hashes[s:e], segments[s:e], around[s:e], place.astype("<u4"), at[s:e].astype("<u4"))
                made.append([int(part[s]), *(x.tobytes() for x in packed), [], [], [], []])
            if made:
                made[0][-4:] = [list(c) for c in zip(*marks, strict=True)] or [[], [], [], []]
            columns = list(zip(*made, strict=True)) or [[]] * len(PIECE)
            types = [pa.int32(), *[pa.binary()] * 7, *[pa.list_(pa.int64())] * 2, *[pa.list_(pa.binary())] * 2]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], PIECE)

        for batch in batches:
            for key, tag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                held.append((key, tag, find_anchors(text.as_buffer(), hasher, config)))
                size += len(text.as_buffer())
                if size >= PIECE_BYTES:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    kinds = ["int", *["binary"] * 7, "array<long>", "array<long>", "array<binary>", "array<binary>"]
    return rows.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(PIECE, kinds, strict=True)))


PIECE = ["part", "ids", "tags", "hash", "segment", "around", "doc", "at", "repeat_key", "repeat_tag", "repeat_at", "repeat_value"]


def unpack(batch: pd.DataFrame) -> list[np.ndarray]:
    hashes, segments, around, at = (
        np.concatenate([np.frombuffer(b, kind) for b in batch[c]]) for c, kind in (("hash", "<u8"), ("segment", "<u8"), ("around", "<u8"), ("at", "<u4"))
    )
    docs, tags = (
        np.concatenate([np.frombuffer(i, "<i8")[np.frombuffer(d, "<u4")] for i, d in zip(batch[c], batch["doc"], strict=True)]) for c in ("ids", "tags")
    )
    return [hashes, segments, around, docs, tags, at]


def meets_another(hashes: np.ndarray, context: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Rows whose anchor and context (which must fit) are those of a row of another document as well.

    Anchor and context are compared by one hash; a chance meeting only asks for a text too many.
    """
    both = mixed(hashes + context * MIX)
    order = np.argsort(both)
    first = np.flatnonzero(np.concatenate(([True], np.diff(both[order]) != 0)))
    own = docs[order]
    several = np.minimum.reduceat(own, first) < np.maximum.reduceat(own, first)
    out = np.zeros(len(order), dtype=bool)
    out[order] = np.repeat(several, np.diff(np.append(first, len(order))))
    return out & (context != 0)


def classify(hashes, segments, around, docs, tags, at):
    """Which anchors lie in a repeated segment, and which need their text.

    The text is needed at all places where the smallest document of a class has it.
    """
    order = np.argsort(segments, kind="stable")
    hashes, segments, around, docs, tags, at = (x[order] for x in (hashes, segments, around, docs, tags, at))
    new_class = np.ones(len(hashes), dtype=bool)
    new_class[1:] = (hashes[1:] != hashes[:-1]) | (segments[1:] != segments[:-1])
    first = np.flatnonzero(new_class)
    sizes = np.diff(np.append(first, len(docs)))
    smallest = np.minimum.reduceat(docs, first) if len(first) else docs
    full = docs > np.repeat(smallest, sizes)
    near = np.zeros(len(first), dtype=bool)
    for i in range(4):
        near |= meets_another(hashes[first], around[first] >> np.uint64(16 * i) & np.uint64(0xFFFF), smallest)
    return hashes, docs, tags, at, full, ~full & np.repeat(near, sizes)


FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
MARK = ["kind", "key", "tag", "at", "value"]
MARK_TYPE = "kind int, key long, tag long, at binary, value binary"


def first_round(pieces: DataFrame) -> DataFrame:
    """``kind, key, tag, at, value``: marks of repeated segments (kind 0) and requests for text (kind 1)."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        hashes, docs, tags, at, full, ask = classify(*unpack(part))
        marks = [(0, *row) for row in pack_marks(docs[full], tags[full], at[full], np.full(int(full.sum()), FULL))]
        for lists in zip(*(part[f"repeat_{c}"] for c in ("key", "tag", "at", "value")), strict=True):
            marks += [(0, *row) for row in zip(*lists, strict=True)]
        asks = [(1, *row) for row in pack_marks(docs[ask], tags[ask], at[ask], hashes[ask])]
        return pd.DataFrame(marks + asks, columns=MARK)

    return pieces.groupBy("part").applyInPandas(run, MARK_TYPE)


class RunLengthIndex:
    """Run-length Burrows-Wheeler transform of segments, exact for strings of up to ``depth`` bytes."""

    def __init__(self, text: np.ndarray, docs: np.ndarray, depth: int):
        """``text`` holds byte values plus one, and 0 before, between and after segments, whose documents ascend."""
        n = len(text)

        def ahead(values: np.ndarray, shift: int) -> np.ndarray:
            return np.concatenate((values[shift:], np.zeros(min(shift, n), dtype=np.int64)))

        bits = (n + 1).bit_length()

        def ordered(values: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
            """Rows by value, then place, and the values in that order; sorting numbers is faster than sorting places."""
            if top + bits > 63:
                rows = np.argsort(values, kind="stable")
                return rows, values[rows]
            packed = np.sort(values << bits | np.arange(n))
            return packed & ((1 << bits) - 1), packed >> bits

        def dense(values: np.ndarray, top: int) -> np.ndarray:
            rows, values = ordered(values, top)
            out = np.empty(n, dtype=np.int64)
            out[rows] = np.cumsum(np.concatenate(([True], values[1:] != values[:-1])))
            return out

        # as many symbols as fit into one number beside the place
        seen = np.bincount(text, minlength=258) > 0
        symbol = np.cumsum(seen) - 1  # keeps the order; 0 is there
        wide = max(1, int(symbol[-1]).bit_length())
        span = max(1, min((63 - bits) // wide, depth - 1))
        code, small = np.zeros(n, dtype=np.int64), symbol[text]
        for k in range(span):
            code = code << wide | ahead(small, k)
        rank = dense(code, span * wide)
        while 2 * span < depth:
            rank = dense(rank << bits | ahead(rank, span), 2 * bits)
            span *= 2
        # two overlapping ranks order ``depth`` symbols; places ascend with the documents, which settles ties
        rows = ordered(rank << bits | ahead(rank, depth - span), 2 * bits)[0]
        same = rank[rows][1:] == rank[rows][:-1]

        def starts_of(length: int) -> np.ndarray:
            tail = ahead(rank, length - span)[rows]
            return np.flatnonzero(np.concatenate(([True], ~same | (tail[1:] != tail[:-1]))))

        self.n = n
        self.depth = depth
        before = text[rows - 1]  # the text begins with 0, so its last byte is 0 too
        starts = starts_of(depth)
        doc = docs[rows]
        several = np.minimum.reduceat(doc, starts) < np.maximum.reduceat(doc, starts)
        cut = np.concatenate(([True], before[1:] != before[:-1]))
        cut[starts[several]] = True
        self.run_start = np.flatnonzero(cut)
        self.run_end = np.append(self.run_start[1:], n)
        self.run_head = before[self.run_start].astype(np.int64)
        self.sample = rows[self.run_start]  # text places at the ends of runs
        self.sample_doc = docs[self.sample]
        lengths = self.run_end - self.run_start
        order = np.lexsort((self.run_start, self.run_head))
        self.by_head = self.run_head[order] * (n + 1) + self.run_start[order]
        self.head_length = lengths[order]
        self.head_before = np.cumsum(self.head_length) - self.head_length
        self.head_of = self.run_head[order]
        counts = np.bincount(text, minlength=258)
        self.smaller = np.cumsum(counts) - counts
        seen = np.bincount(self.run_head, weights=lengths, minlength=258).astype(np.int64)
        self.head_first = np.cumsum(seen) - seen
        begins = np.zeros(n, dtype=np.int64)
        short = starts_of(depth - 1)
        begins[short] = short
        self.short_start = np.maximum.accumulate(begins)  # first row of the rows that agree in all but the last byte
        begins[:] = 0
        begins[starts] = starts
        self.place_start = np.empty(n, dtype=np.int64)
        self.place_start[rows] = np.maximum.accumulate(begins)  # of a text place: first row of its string

    def rank(self, head: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Rows before ``row`` whose byte is ``head``, from the runs alone."""
        at = np.searchsorted(self.by_head, head * (self.n + 1) + row, side="left") - 1
        real = at >= 0
        at = np.maximum(at, 0)
        own = real & (self.head_of[at] == head)
        start = self.by_head[at] - head * (self.n + 1)
        count = self.head_before[at] - self.head_first[head] + np.minimum(self.head_length[at], row - start)
        return np.where(own, count, 0)

    def step(self, low: np.ndarray, head: np.ndarray) -> np.ndarray:
        """First row of the string that has ``head`` before the string of ``low``, without its last byte.

        The strings must be in the index, as those of its own segments are.
        """
        return self.smaller[head] + self.rank(head, self.short_start[low])

    def smallest_doc(self, low: np.ndarray) -> np.ndarray:
        """Document of the sample at a row; rows inside a run belong to strings of one document."""
        at = np.searchsorted(self.run_start, low, side="right") - 1
        return np.where(self.run_start[at] == low, self.sample_doc[at], np.iinfo(np.int64).max)


def match_segments(segments: list[bytes], docs: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, start) of every string of ``depth`` bytes that a smaller document has."""
    order = np.argsort(docs, kind="stable")
    segments, docs = [segments[i] for i in order.tolist()], docs[order]
    sizes = np.array([len(s) for s in segments], dtype=np.int64)
    text = np.zeros(int(sizes.sum()) + len(segments) + 1, dtype=np.int64)
    ends = np.cumsum(sizes + 1)  # place of the 0 after each segment
    owner = np.full(len(text), np.iinfo(np.int64).max)
    flat = np.frombuffer(b"".join(segments), dtype=np.uint8)
    place = np.arange(len(flat)) + np.repeat(np.arange(len(segments)), sizes) + 1
    text[place] = flat.astype(np.int64) + 1
    owner[place] = np.repeat(docs, sizes)
    index = RunLengthIndex(text, owner, depth)
    low = np.zeros(len(segments), np.int64)
    whole = np.flatnonzero(sizes >= depth)
    low[whole] = index.place_start[ends[whole] - depth]  # a segment is in the index, so the rows of its last string are known
    which, starts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for back in range(depth, int(sizes.max()) + 1):
        at = np.flatnonzero(sizes >= back)
        if back > depth:
            low[at] = index.step(low[at], text[ends[at] - back])
        at = at[index.smallest_doc(low[at]) < docs[at]]
        which.append(at)
        starts.append(sizes[at] - back)
    return order[np.concatenate(which)], np.concatenate(starts)


def cut_segments(asked: DataFrame, parts: int, config: RepeatConfig) -> DataFrame:
    """``row, part, at, left, segment``: the text around every anchor that was asked for."""

    def start():
        def cut(texts, at, values):
            picked, out = [], []
            for i, text in enumerate(texts):
                for place, value in zip(
                    np.frombuffer(b"".join(at[i]), "<u4").tolist(), np.frombuffer(b"".join(values[i]), "<u8").tolist(), strict=True
                ):
                    left = max(0, place - config.reach + 1)
                    picked.append(i)
                    out.append(((value >> 16) % parts, place, left, text[left : place + config.length]))
            return picked, [list(c) for c in zip(*out, strict=True)] or [[]] * 4

        return cut

    return map_keyed(asked, start, "part int, at long, left long, segment binary")


def second_round(segments: DataFrame, config: RepeatConfig) -> DataFrame:
    """``kind, key, tag, at, value``: for every segment the bits of its repeated strings."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        docs, tags, at = (rows[c].to_numpy() for c in ("key", "tag", "at"))
        rows["before"] = rows["at"] - rows["left"]
        once = rows.groupby(["key", "before", "segment"], sort=False).ngroup().to_numpy()  # a text that a document has several times
        first = np.unique(once, return_index=True)[1]
        which, starts = match_segments(rows["segment"].iloc[first].tolist(), docs[first], config.length)
        found = np.zeros(len(first), dtype=np.uint64)
        shift = starts - rows["before"].to_numpy()[first][which] + config.reach - 1
        own = (shift >= 0) & (shift < config.reach)  # bit b: the string that begins reach - 1 - b bytes before the anchor
        np.bitwise_or.at(found, which[own], np.uint64(1) << shift[own].astype(np.uint64))
        bits = found[once]
        hit = bits > 0
        marks = [(0, *row) for row in pack_marks(docs[hit], tags[hit], at[hit], bits[hit])]
        return pd.DataFrame(marks, columns=MARK)

    return segments.select("part", "row.*", "at", "left", "segment").groupBy("part").applyInPandas(run, MARK_TYPE)


def repeated(n: int, at: list[bytes], values: list[bytes], config: RepeatConfig) -> np.ndarray:
    """Which of the ``n`` bytes are covered by a marked string."""
    places = np.frombuffer(b"".join(at), "<u4").astype(np.int64) - config.reach + 1
    bits = np.unpackbits(np.frombuffer(b"".join(values), np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    mark, shift = np.nonzero(bits[:, : config.reach])
    start = places[mark] + shift
    begins = np.zeros(n, dtype=bool)
    begins[start[(start >= 0) & (start + config.length <= n)]] = True
    begun = np.cumsum(begins)  # a byte goes if a marked string begins in the ``length`` places up to it
    begun[config.length :] -= begun[: -config.length].copy()
    return begun > 0


def remove_repeats(docs: DataFrame, config: RepeatConfig = RepeatConfig(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, removed, kept`` of every row.

    ``removed`` lists the maximal runs of removed bytes as (start, stop) and ``kept`` is the rest of
    the text. A byte goes if a string of ``length`` bytes that covers it also starts in a row with a smaller
    key, judged on the input. NULL and empty texts lose nothing. A row with a NULL key loses
    nothing and is no source; rows with equal keys are no sources for each other, and each loses what its own
    text repeats. Keys must be integers. An empty table gives an empty result.
    """
    whole = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    whole = whole.select("key", F.xxhash64("text").alias("tag"), "text")  # texts of one key are told apart by the tag
    rows = whole.where(F.col("key").isNotNull()).withColumn("key", F.col("key").cast("long"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, int(2 * n_bytes / (config.reach + 1) / PART_ANCHORS) + 1)
    pieces = anchor_pieces(rows.where(F.octet_length("text") >= config.length), parts, config)
    found = materialise(first_round(pieces), "repeat_marks")

    def lists(marks: DataFrame) -> DataFrame:
        return marks.groupBy("key", "tag").agg(F.collect_list("at").alias("at"), F.collect_list("value").alias("value"))

    asked = rows.join(lists(found.where("kind = 1")), ["key", "tag"]).select(F.struct("key", "tag").alias("row"), "text", "at", "value")
    n_asked = found.where("kind = 1").agg(F.sum(F.octet_length("at"))).first()[0] or 0
    segments = cut_segments(asked, int(n_asked / 4 / PART_SEGMENTS) + 1, config)
    more = materialise(second_round(segments, config), "repeat_matches")
    marks = lists(found.where("kind = 0").unionAll(more))
    joined = whole.join(marks, ["key", "tag"], "left").select("key", "text", "at", "value")

    def start():
        def cut(texts, at, values):
            spans, kept = [], []
            for t, a, v in zip(texts, at, values, strict=True):
                gone = repeated(len(t), a, v, config) if a else np.zeros(len(t), dtype=bool)
                turn = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
                spans.append([{"start": int(s), "stop": int(e)} for s, e in turn.reshape(-1, 2)])
                kept.append(np.frombuffer(t, np.uint8)[~gone].tobytes())
            return None, [[len(t) for t in texts], spans, kept]

        return cut

    return map_keyed(joined, start, "n_bytes long, removed array<struct<start: long, stop: long>>, kept binary").withColumnRenamed("key", key)


def repeat_report(docs: DataFrame, config: RepeatConfig = RepeatConfig(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row."""
    found = remove_repeats(docs, config, key, text)
    return found.select(
        key, "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
