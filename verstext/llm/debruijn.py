"""Repeated word spans by compaction of a de Bruijn graph.

Every window of ``window`` words is an edge from the node of its first to the node of its last
``window - 1`` words. Edges that the corpus has more than once are repeats.

1. *Stretches.* The lowest hash among the ``seed``-word strings of a window is its anchor, so equal
   windows have equal anchors. Neighbouring windows with one anchor are one stretch: a piece of a path
   that travels as one row (anchor, hash of its words, place), not window by window.
2. *Edge counts.* A stretch whose anchor occurs once holds no repeat. If all stretches of an anchor are
   equal, their number counts all their edges. Only anchors with different stretches have their
   windows counted one by one, once for each distinct stretch.
3. *Compaction.* A path goes on through a node if every occurrence of the edge before it is followed
   by the edge behind it, and the other way round. Inside a stretch the sets of stretches that hold
   both edges must be equal; between stretches the strings of ``window + 1`` words across the border
   are counted and joined back. A document's run of edges is cut at all other nodes, so each
   occurrence of a path is whole and no path has to be followed over several rounds.
4. *Verification.* Each path occurrence is read at its source coordinates and the 128-bit digest of
   its words has to be found as often as its edges were counted. Otherwise two texts shared a 64-bit
   hash and the search is run again with other hash values.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from verstext.llm.rows import map_keyed
from verstext.llm.substring_dedup import BASE, INVERSE, mixed, sliding
from verstext.runtime import discard, materialise

PIECE_BYTES = 2_000_000
PLACE_BITS = 24  # of a window's sort key; the rest is the hash
ATTEMPTS = 3


@dataclass(frozen=True)
class WindowConfig:
    window: int = 35
    seed: int = 8
    hash_seed: int = 1


class WordHashes:
    """Hashes of words and of ranges of words, by prefix sums of values times powers of an odd base."""

    def __init__(self, hash_seed: int):
        self.values = np.random.default_rng(hash_seed).integers(1, 2**63, 256, dtype=np.uint64)
        self.spaces = np.zeros(256, dtype=bool)
        self.spaces[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
        self.power = self.inverse = np.ones(1, dtype=np.uint64)

    def sums(self, values: np.ndarray) -> np.ndarray:
        if len(self.power) <= len(values):
            size = max(len(values) + 1, 2 * len(self.power), 1 << 16)
            self.power = np.concatenate(([np.uint64(1)], np.cumprod(np.full(size, BASE))))
            self.inverse = np.concatenate(([np.uint64(1)], np.cumprod(np.full(size, INVERSE))))
        out = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * self.power[: len(values)], out=out[1:])
        return out

    def ranges(self, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((sums[stop] - sums[start]) * self.inverse[start])

    def words(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and row of every word of rows of bytes that lie one behind the other."""
        inside = ~self.spaces[data]
        border = np.zeros(len(data) + 1, dtype=bool)
        border[bounds] = True
        first, last = inside.copy(), inside.copy()
        first[1:] &= self.spaces[data[:-1]] | border[1:-1]
        last[:-1] &= self.spaces[data[1:]] | border[1:-1]
        start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
        hashes = mixed(self.ranges(self.sums(self.values[data]), start, stop) + (stop - start).astype(np.uint64))
        return hashes, np.searchsorted(bounds, start, side="right") - 1


def anchor_places(seeds: np.ndarray, span: int) -> np.ndarray:
    """For every ``span`` neighbours the place of the lowest hash, the first one among equal ones."""
    low = np.uint64(PLACE_BITS)
    block = (1 << PLACE_BITS) - span
    found = [np.zeros(0, np.int64)]
    for at in range(0, len(seeds) - span + 1, block):
        part = seeds[at : at + block + span - 1]
        keys = part >> low << low | np.arange(len(part), dtype=np.uint64)
        found.append((sliding(keys, span, np.minimum) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64) + at)
    return np.concatenate(found)


def stretches(data: np.ndarray, bounds: np.ndarray, hasher: WordHashes, config: WindowConfig):
    """(row, first window, windows, anchor hash, hash of the words, hash across the right border or 0)."""
    words, row = hasher.words(data, bounds)
    n = len(words)
    if n < config.window:
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 3
    sums = hasher.sums(words)
    at = np.arange(n - config.seed + 1)
    seeds = hasher.ranges(sums, at, at + config.seed)
    anchors = anchor_places(seeds, config.window - config.seed + 1)
    starts = np.flatnonzero(row[config.window - 1 :] == row[: n - config.window + 1])
    own = anchors[starts]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (own[1:] != own[:-1]) | (row[starts[1:]] != row[starts[:-1]])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(starts)))
    start, anchor = starts[first], own[first]
    content = hasher.ranges(sums, start, start + count + config.window - 1)
    content = mixed(content + (count * 64 + anchor - start).astype(np.uint64))
    last = start + count - 1
    goes_on = np.zeros(len(start), dtype=bool)
    goes_on[:-1] = start[1:] == last[:-1] + 1
    goes_on[:-1] &= row[start[1:]] == row[start[:-1]]
    across = np.zeros(len(start), dtype=np.uint64)
    across[goes_on] = hasher.ranges(sums, last[goes_on], last[goes_on] + config.window + 1) | np.uint64(1)
    begin = np.searchsorted(row, row[start])  # first word of the row
    return row[start], start - begin, count, seeds[anchor], content, across


def byte_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without NULLs, and where each row begins."""
    wide = column.cast(pa.large_binary())
    bounds = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    body = wide.buffers()[2]
    data = np.frombuffer(body, np.uint8)[bounds[0] : bounds[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def small_slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of about ``PIECE_BYTES``; a larger row is a slice of its own."""
    bounds = byte_rows(batch.column(column))[1]
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + PIECE_BYTES, side="right")) - 1)
        yield batch.slice(at, stop - at)
        at = stop


def stretch_rows(texts: DataFrame, config: WindowConfig) -> DataFrame:
    """``text_id, at, size, anchor, content, across`` of every stretch of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHashes(config.hash_seed)
        names = ["text_id", "at", "size", "anchor", "content", "across"]
        for batch in batches:
            for piece in small_slices(batch, 1):
                row, at, size, *hashes = stretches(*byte_rows(piece.column(1)), hasher, config)
                anchor, content, across = (h.view(np.int64) for h in hashes)
                columns = [
                    piece.column(0).take(pa.array(row)), pa.array(at.astype(np.int32)), pa.array(size.astype(np.int32)),
                    pa.array(anchor), pa.array(content), pa.array(across, mask=across == 0),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    return texts.mapInArrow(run, "text_id long, at int, size int, anchor long, content long, across long")


def window_hashes(asked: DataFrame, config: WindowConfig) -> DataFrame:
    """``anchor, content, times, windows``: the hash of each window of the stretches asked for."""

    def start():
        hasher = WordHashes(config.hash_seed)

        def cut(texts, lists):
            picked, out = [], []
            for i, (text, wanted) in enumerate(zip(texts, lists, strict=True)):
                words = hasher.words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]
                sums = hasher.sums(words)
                for w in wanted:
                    at = np.arange(w["at"], w["at"] + w["size"])
                    if at[-1] + config.window > len(words):
                        continue  # asked of another text with this id
                    picked.append(i)
                    out.append((w["anchor"], w["content"], w["times"], hasher.ranges(sums, at, at + config.window).view(np.int64)))
            return picked, [list(c) for c in zip(*out, strict=True)] or [[]] * 4

        return cut

    return map_keyed(asked, start, "anchor long, content long, times long, windows array<long>").drop("text_id")


def count_edges(texts: DataFrame, config: WindowConfig) -> DataFrame:
    """``text_id, edges`` of every text with repeated windows.

    ``edges`` lists stretches as (at, size, times, across_times, counted): ``times`` counts each
    window unless ``counted`` does, which lists (place, times, holders) of the repeated windows.
    """
    every = materialise(stretch_rows(texts, config), "stretches")
    anchors = every.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("content").alias("low"), F.max("content").alias("high"))
    several = anchors.where("n > 1").select("anchor", (F.col("low") < F.col("high")).alias("mixed"))
    several = materialise(several, "anchors_again")  # so that both sides of the join are dealt anew and a frequent anchor can be split
    found = materialise(every.join(several, "anchor"), "stretches_again")
    discard(every, several)
    once = found.groupBy(*found.columns).agg(F.count(F.lit(1)).alias("copies"))  # rows with equal texts
    once = materialise(once, "stretches_once")
    discard(found)
    source = F.min(F.struct("text_id", "at", "size")).alias("source")
    classes = once.groupBy("anchor", "content").agg(F.sum("copies").alias("times"), F.first("mixed").alias("mixed"), source)
    classes = materialise(classes, "stretch_classes")

    wanted = classes.where("mixed").select("source.*", "anchor", "content", "times")
    wanted = wanted.groupBy("text_id").agg(F.collect_list(F.struct("at", "size", "anchor", "content", "times")).alias("wanted"))
    wanted = materialise(wanted, "stretches_wanted")
    cut = window_hashes(texts.join(wanted, "text_id"), config).dropDuplicates(["anchor", "content"])
    cut = materialise(cut, "windows")
    windows = cut.select("anchor", "content", "times", F.posexplode("windows").alias("place", "window"))
    again = windows.groupBy("anchor", "window").agg(
        F.sum("times").alias("window_times"), F.bit_xor(F.xxhash64("content")).alias("holders")
    ).where("window_times > 1")
    again = materialise(again, "windows_again")
    counted = windows.drop("times").join(again, ["anchor", "window"]).groupBy("anchor", "content").agg(
        F.collect_list(F.struct("place", F.col("window_times").alias("times"), "holders")).alias("counted")
    )
    known = classes.join(counted, ["anchor", "content"], "left").where("not mixed or counted is not null")
    known = materialise(known.select("anchor", "content", "times", "counted"), "edges")
    discard(classes, wanted, cut, again)
    borders = once.where("across is not null").groupBy("anchor", "across").agg(F.sum("copies").alias("across_times"))
    borders = materialise(borders.where("across_times > 1"), "borders")
    places = materialise(once.join(known, ["anchor", "content"]), "edge_places")
    discard(known, once)
    edges = places.join(borders, ["anchor", "across"], "left")
    listed = edges.groupBy("text_id").agg(F.collect_list(F.struct("at", "size", "times", "across_times", "counted")).alias("edges"))
    listed = materialise(listed, "edge_lists")
    discard(places, borders)
    return listed


def paths(n_words: int, edges: list[dict], window: int) -> list[tuple[int, int, int]]:
    """(first word, end, times) of every path of a text."""
    n = max(0, n_words - window + 1)
    times, holders, through = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64), np.zeros(n + 1, bool)
    for e in edges:
        at, end = e["at"], e["at"] + e["size"]
        if end > n:
            continue  # a place of another text with this id
        if e["counted"] is None:
            times[at:end] = e["times"]
        else:
            for c in e["counted"]:
                times[at + c["place"]], holders[at + c["place"]] = c["times"], c["holders"]
        through[at : end - 1] = (times[at : end - 1] == times[at + 1 : end]) & (holders[at : end - 1] == holders[at + 1 : end])
    for e in edges:  # borders, when all windows are counted
        last = e["at"] + e["size"] - 1
        if last < n and e["across_times"] is not None:
            through[last] = times[last] == times[last + 1] == e["across_times"]
    again = np.flatnonzero(times[:n])
    if not len(again):
        return []
    new = np.ones(len(again), dtype=bool)
    new[1:] = (again[1:] != again[:-1] + 1) | ~through[again[:-1]]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(again)) - 1
    return list(zip(again[first].tolist(), (again[last] + window).tolist(), times[again[first]].tolist(), strict=True))


def cut_paths(texts: DataFrame, config: WindowConfig) -> DataFrame:
    """``key, n_words, n_removed, kept, paths`` from ``key, text, edges``."""

    def start():
        def cut(columns, lists):
            counts, removed, kept, found = [], [], [], []
            for text, edges in zip(columns, lists, strict=True):
                words = text.split()  # of bytes: x20 and x09-x0D
                own = paths(len(words), edges or [], config.window)
                stays = np.ones(len(words), dtype=bool)
                for first, end, _ in own:
                    stays[first:end] = False
                digests = [hashlib.blake2b(b" ".join(words[a:b]), digest_size=16).digest() for a, b, _ in own]
                found.append([{"start": a, "stop": b, "times": t, "digest": d} for (a, b, t), d in zip(own, digests, strict=True)])
                counts.append(len(words))
                removed.append(len(words) - int(stays.sum()))
                kept.append(b" ".join(words[i] for i in np.flatnonzero(stays).tolist()).decode() if own else b" ".join(words).decode())
            return None, [counts, removed, kept, found]

        return cut

    spans = "array<struct<start: long, stop: long, times: long, digest: binary>>"
    return map_keyed(texts, start, f"n_words long, n_removed long, kept string, paths {spans}")


def unconfirmed(cut: DataFrame) -> DataFrame:
    """Paths whose words the corpus does not have as often as their edges were counted."""
    found = cut.select(F.explode("paths").alias("p")).groupBy("p.digest", "p.times").agg(F.count(F.lit(1)).alias("n"))
    return found.where("n != times")


def remove_repeated_spans(docs: DataFrame, config: WindowConfig = WindowConfig(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept, paths`` of every row.

    Words are stretches without white space (x20, x09-x0D). A word goes if a window of
    ``config.window`` words that covers it also begins anywhere else, in this row or another one;
    windows are judged on the input. ``kept`` joins the rest by one space; ``paths`` lists the compacted
    paths as (first word, end, occurrences in the corpus, digest of the words).

    Each row is judged by its own text, so rows with equal or NULL keys are rows like any other. A NULL
    or empty text, or one with fewer words than a window, loses nothing and has no paths. An empty
    table gives an empty result. Extra columns are not read.
    """
    whole = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    whole = whole.withColumn("text_id", F.xxhash64("text"))
    texts = whole.select("text_id", "text").where(F.octet_length("text") >= 2 * config.window - 1)
    for attempt in range(ATTEMPTS):
        trial = WindowConfig(config.window, config.seed, config.hash_seed + attempt)
        marked = whole.join(count_edges(texts, trial), "text_id", "left").select("key", "text", "edges")
        cut = materialise(cut_paths(marked, trial), "cut_paths")
        if unconfirmed(cut).isEmpty():
            return cut.withColumnRenamed("key", key)
    raise RuntimeError(f"paths were not confirmed with {ATTEMPTS} sets of hash values")


def repeated_paths(cut: DataFrame) -> DataFrame:
    """``digest, n_words, n_occurrences`` of the paths in a result of ``remove_repeated_spans``."""
    found = cut.select(F.explode("paths").alias("p")).select("p.*")
    return found.groupBy("digest").agg(F.first(F.col("stop") - F.col("start")).alias("n_words"), F.count(F.lit(1)).alias("n_occurrences"))


def span_report(docs: DataFrame, config: WindowConfig = WindowConfig(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row."""
    cut = remove_repeated_spans(docs, config, key, text)
    return cut.select(key, "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
