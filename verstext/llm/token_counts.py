"""Token counts of a byte-level BPE by rank-synchronous merging of ragged arrays.

Pre-tokens are held as one flat array of symbol numbers with their bounds. In each round every
pre-token finds the lowest rank among its neighbouring pairs and applies that pair at all its
places at once. A merged symbol can only take part in pairs of a higher rank than the pair that
made it, so rounds give the same symbols as one merge at a time. Surviving symbols are counted.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import regex
from pyspark.sql import DataFrame, functions as F

from verstext.llm.rows import map_keyed, once_per_worker

PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_ENTRIES = 1_000_000
CACHE_CHARS = 32


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(shifted)}


class RankMerger:
    """A BPE vocabulary as arrays, with the counts of the pre-tokens met so far."""

    def __init__(self, definition: dict):
        model = definition["model"]
        ids = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        self.width = max(ids.values()) + 1
        keys = np.array([ids[a] * self.width + ids[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([ids[a + b] for a, b in merges], dtype=np.int64)
        symbols = byte_symbols()
        self.of_byte = np.array([ids[symbols[b]] for b in range(256)], dtype=np.int64)
        self.none = len(merges)
        self.added = [t["content"] for t in definition.get("added_tokens", [])]
        self.split = regex.compile(PRE_TOKEN)
        self.mark = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) or r"(?!)")
        self.known: dict[str, int] = {}
        self.long: list[str] = []

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], self.none)

    def merge_counts(self, pieces: list[str]) -> np.ndarray:
        """Number of symbols that are left of each pre-token."""
        raw = [p.encode() for p in pieces]
        lengths = np.array([len(r) for r in raw], dtype=np.int64)
        symbols = self.of_byte[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(raw)), lengths)
        counts = lengths.copy()
        while len(symbols) > 1:
            inside = owner[1:] == owner[:-1]
            ranks = np.where(inside, self.pair_ranks(symbols[:-1], symbols[1:]), self.none)
            first = np.flatnonzero(np.concatenate(([True], ~inside)))
            lowest = np.full(len(raw), self.none, dtype=np.int64)
            lowest[owner[first]] = np.minimum.reduceat(np.append(ranks, self.none), first)
            alive = lowest[owner] < self.none
            hit = np.zeros(len(symbols), dtype=bool)
            hit[:-1] = (ranks == lowest[owner[:-1]]) & (ranks < self.none)
            places = np.flatnonzero(hit)
            if not len(places):
                break
            # of places in a row (a pair of equal symbols) every second one counts, from the left
            fresh = np.ones(len(places), dtype=bool)
            fresh[1:] = places[1:] != places[:-1] + 1
            run_start = np.maximum.accumulate(np.where(fresh, np.arange(len(places)), 0))
            places = places[(np.arange(len(places)) - run_start) % 2 == 0]
            symbols = symbols.copy()
            symbols[places] = self.merged[lowest[owner[places]]]
            counts -= np.bincount(owner[places], minlength=len(raw))
            keep = alive
            keep[places + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return counts

    def learn(self, pieces: list[str], batch_bytes: int = 1 << 20) -> None:
        """Add the counts of new pre-tokens."""
        pieces = sorted(pieces, key=len)
        start = size = 0
        for stop, piece in enumerate(pieces, 1):
            size += 4 * len(piece)
            if size >= batch_bytes or stop == len(pieces):
                self.known.update(zip(pieces[start:stop], self.merge_counts(pieces[start:stop]).tolist(), strict=True))
                start, size = stop, 0

    def forget(self) -> None:
        """Bound the memory: drop long pre-tokens, and all of them when there are too many."""
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        for piece in self.long:
            self.known.pop(piece, None)
        self.long.clear()

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text; strings of added tokens count as one."""
        totals, parts = [0] * len(texts), []
        for i, text in enumerate(texts):
            if self.added and any(t in text for t in self.added):
                totals[i] += len(self.mark.findall(text))
                parts += [(i, s) for s in self.mark.split(text) if s]
            elif text:
                parts.append((i, text))
        cut = [(i, self.split.findall(text)) for i, text in parts]
        new = set().union(*(pieces for _, pieces in cut)).difference(self.known)
        if new:
            self.long += [p for p in new if len(p) > CACHE_CHARS]
            self.learn(list(new))
        for i, pieces in cut:
            totals[i] += sum(map(self.known.__getitem__, pieces))
        self.forget()
        return totals


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row.

    ``tokenizer`` is the path of a byte-level BPE in the ``tokenizers`` format; its content is read
    on the driver (a vocabulary of fixed size) and sent with the tasks. A NULL or empty text has 0
    bytes and 0 tokens. Rows with a NULL or repeated key are counted like any other; columns
    beside key and text are not read. There is no shuffle.
    """
    with open(tokenizer, encoding="utf-8") as f:
        shared, name = docs.sparkSession.sparkContext.broadcast(json.load(f)), uuid.uuid4().hex

    content = F.coalesce(F.col(text), F.lit(""))
    sized = docs.select(F.col(key), content.alias("text"), F.octet_length(content).cast("long").alias("n_bytes"))

    def start():
        merger = once_per_worker(name, lambda: RankMerger(shared.value))
        return lambda texts, sizes: (None, [sizes, merger.count(texts)])

    found = map_keyed(sized, start, "n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
