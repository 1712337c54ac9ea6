"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (with word bounds) hashed into buckets; a text is the
mean of the embeddings of all its n-grams; the mean goes through a linear layer and a softmax over
two classes. Embeddings and layer are trained together, so a misspelling that was never seen still
shares most of its n-gram vectors with the word it stands for.

The mean is weighted: each n-gram of a word that comes n times has weight 1 + log n, and ``blank`` counts
as so much weight of n-grams that say nothing, so that a few words do not decide about a short text.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from verstext.llm.rows import keep_rows, map_keyed


@dataclass(frozen=True)
class ToxicityConfig:
    """``toxic_rows`` and ``clean_rows`` bound the labelled rows that are fitted; at most 65,536 buckets.

    Words of more than ``cache_chars`` characters are read whole, but not remembered.
    """

    buckets: int = 1 << 16
    dim: int = 8
    shortest: int = 3
    longest: int = 5
    least_texts: int = 5
    blank: float = 300.0
    toxic_rows: int = 2000
    clean_rows: int = 4000
    epochs: int = 6
    least_steps: int = 270
    batch: int = 128
    rate: float = 0.04
    seed: int = 7
    cache_words: int = 300_000
    cache_chars: int = 64


STRIP = " \t\r\n\x0b\x0c.,;:!?\"'()[]{}|"


def words_of(text: str) -> list[str]:
    return [w for w in (p.strip(STRIP) for p in text.lower().split()) if w]


LONG_WORD = 4096


def crc_table() -> np.ndarray:
    """The CRC-32 of each byte, by the rule of its polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


def long_subwords(marked: bytes, config: ToxicityConfig) -> np.ndarray:
    """Distinct CRC-32 of the n-grams of a long word, by arrays over its bytes."""
    data = np.frombuffer(marked, np.uint8)
    bounds = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # where characters begin
    table, found = crc_table(), [np.array([zlib.crc32(marked)], dtype=np.uint32)]
    for n in range(config.shortest, config.longest + 1):
        start, stop = bounds[:-n], bounds[n:]
        crc = np.full(len(start), 0xFFFFFFFF, dtype=np.uint32)
        for step in range(int((stop - start).max())):
            inside = np.flatnonzero(start + step < stop)
            crc[inside] = table[(crc[inside] ^ data[start[inside] + step]) & 0xFF] ^ (crc[inside] >> np.uint32(8))
        found.append(np.unique(~crc))
    return np.concatenate(found)


def subwords(word: str, config: ToxicityConfig) -> list[int]:
    """Bucket numbers of the n-grams of one word and of the word itself."""
    marked = f"<{word}>"
    if len(word) > LONG_WORD:
        return (long_subwords(marked.encode("utf-8", "replace"), config) % np.uint32(config.buckets)).tolist()
    data = marked.encode("utf-8", "replace")
    if len(data) == len(marked):  # of one byte each, so the bytes can be cut themselves
        grams = [data[i : i + n] for n in range(config.shortest, config.longest + 1) for i in range(len(data) - n + 1)]
    else:
        grams = [marked[i : i + n].encode("utf-8", "replace") for n in range(config.shortest, config.longest + 1) for i in range(len(marked) - n + 1)]
    crc, buckets = zlib.crc32, config.buckets
    return [crc(g) % buckets for g in dict.fromkeys([data, *grams])]


def pack_words(text: str, config: ToxicityConfig, ids: dict[str, array]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares of all its n-grams."""
    grams, weights = [], []
    for word, n in sorted(Counter(words_of(text)).items()):
        found = ids.get(word)
        if found is None:
            if len(ids) > config.cache_words:
                ids.clear()
            found = subwords(word, config)
            if len(word) <= config.cache_chars:
                ids[word] = array("i", found)  # a list would hold an object for each number
        grams += found
        weights += [1 + math.log(n)] * len(found)
    if not grams:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    buckets, at = np.unique(np.array(grams, dtype=np.int32), return_inverse=True)
    share = np.bincount(at, weights=weights)
    return buckets, (share / (share.sum() + config.blank)).astype(np.float32)


@dataclass
class ToxicityModel:
    """``gram_score`` is the embedding table times the layer: what one n-gram adds to the margin."""

    gram_score: np.ndarray
    margin_bias: float


class PackedBags(Sequence):
    """Bags that stay compressed; one is opened when it is asked for, so a sample is not held in full."""

    def __init__(self, sizes: Sequence[int], packed: Sequence[bytes]):
        self.sizes, self.packed = sizes, packed

    def __len__(self) -> int:
        return len(self.packed)

    def __getitem__(self, at: int) -> tuple[np.ndarray, np.ndarray]:
        n = int(self.sizes[at])
        opened = pa.Codec("zstd").decompress(self.packed[at], 6 * n, asbytes=True)
        return np.cumsum(np.frombuffer(opened, np.uint16, n), dtype=np.uint16), np.frombuffer(opened, np.float32, n, 2 * n)


def pack_bag(grams: bytes, share: bytes) -> bytes:
    """Sorted buckets as steps, and the shares, of which many are equal."""
    steps = np.diff(np.frombuffer(grams, np.uint16), prepend=np.uint16(0))
    return pa.Codec("zstd").compress(steps.tobytes() + share, asbytes=True)


def train(bags: Sequence[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, config: ToxicityConfig) -> ToxicityModel:
    """Adam on the cross entropy of the softmax, embeddings and layer together."""
    rng = np.random.default_rng(config.seed)
    table = rng.normal(0, 0.01, (config.buckets, config.dim)).astype(np.float32)
    texts = np.zeros(config.buckets, dtype=np.int64)
    for ids, _ in bags:  # an n-gram is in a bag once
        texts[ids] += 1
    seen = texts >= config.least_texts
    table[~seen] = 0  # rare n-grams say nothing
    layer = rng.normal(0, 0.5, (config.dim, 2)).astype(np.float32)
    bias = np.zeros(2, dtype=np.float32)
    params = [table, layer, bias]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(max(config.epochs, -(-config.least_steps * config.batch // len(bags)))):
        order = rng.permutation(len(bags))
        for start in range(0, len(order), config.batch):
            rows = order[start : start + config.batch]
            chosen = [(ids[seen[ids]], share[seen[ids]]) for ids, share in (bags[r] for r in rows)]
            sizes = np.array([len(ids) for ids, _ in chosen])
            ids, share = (np.concatenate(part) for part in zip(*chosen))
            owner = np.repeat(np.arange(len(rows)), sizes)
            mean = np.stack(
                [np.bincount(owner, weights=table[ids, k] * share, minlength=len(rows)) for k in range(config.dim)], axis=1
            )
            logits = mean @ layer + bias
            logits -= logits.max(axis=1, keepdims=True)
            prob = np.exp(logits)
            prob /= prob.sum(axis=1, keepdims=True)
            error = prob
            error[np.arange(len(rows)), labels[rows]] -= 1
            error /= len(rows)
            back = error @ layer.T
            grad_table = np.stack(
                [np.bincount(ids, weights=back[owner, k] * share, minlength=config.buckets) for k in range(config.dim)], axis=1
            )
            step += 1
            for p, g, m, v in zip(params, (grad_table, mean.T @ error, error.sum(axis=0)), first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= config.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return ToxicityModel((table @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def labelled_bags(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, config: ToxicityConfig) -> DataFrame:
    """The bags of a bounded sample of labelled rows, compressed: the lowest key hashes of each class."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(key).agg(F.max(label).cast("int").alias("label"))
    learnt = known.where(~held_out(key)).withColumn("order", F.xxhash64(key))
    parts = [
        learnt.where(F.col("label") == value).orderBy("order", key).limit(rows).select(key, "label")
        for value, rows in ((1, config.toxic_rows), (0, config.clean_rows))
    ]
    sample = F.broadcast(parts[0].unionAll(parts[1]))  # at most toxic_rows + clean_rows ids
    rows = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text")).join(sample, key)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: dict[str, array] = {}
        for batch in batches:
            bags = [pack_words(t, config, ids) for t in batch["text"]]
            yield pd.DataFrame({
                "key": batch[key], "label": batch["label"],
                "grams": [b.astype(np.uint16).tobytes() for b, _ in bags], "share": [s.tobytes() for _, s in bags],
            })

    kind = docs.schema[key].dataType.simpleString()
    bags = rows.mapInPandas(pack, f"key {kind}, label int, grams binary, share binary")
    one = bags.groupBy("key").agg(F.min(F.struct("label", "grams", "share")).alias("row"))  # repeated rows count once
    rows = one.select("key", "row.*")

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, share = (batch.column(c).to_pylist() for c in ("grams", "share"))
            sizes, packed = pa.array([len(g) // 2 for g in grams], pa.int32()), pa.array(map(pack_bag, grams, share), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), sizes, packed], ["key", "label", "size", "bag"])

    return rows.mapInArrow(squeeze, StructType([rows.schema["key"], rows.schema["label"], StructField("size", IntegerType()), StructField("bag", BinaryType())]))


def held_out(key: str):
    """Rows that no model may learn from: CRC-32 of the key's text divisible by 5."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
        config: ToxicityConfig = ToxicityConfig()) -> ToxicityModel:
    """Train on the sample, which is small enough for one task, and return its one row for each bucket.

    If a class has no rows, every score is the smoothed share of class 1.
    """

    def learn(sample: pd.DataFrame) -> pd.DataFrame:
        sample = sample.sort_values("key")
        targets = sample["label"].to_numpy(dtype=np.int64)
        if len(set(targets)) < 2:
            model = constant(targets, config)
        else:
            model = train(PackedBags(sample["size"].to_list(), sample["bag"].to_list()), targets, config)
        return pd.DataFrame({"scores": [model.gram_score.tobytes()], "bias": [model.margin_bias]})

    bags = labelled_bags(docs, labels, key, text, label, config)
    made = bags.groupBy(F.lit(0).alias("all")).applyInPandas(learn, "scores binary, bias double").first()
    if made is None:
        return constant(np.zeros(0), config)
    return ToxicityModel(np.frombuffer(made["scores"], np.float32), made["bias"])


def constant(targets: np.ndarray, config: ToxicityConfig) -> ToxicityModel:
    share = (targets.sum() + 1) / (len(targets) + 2)
    return ToxicityModel(np.zeros(config.buckets, np.float32), math.log(share / (1 - share)))


def scorer(docs: DataFrame, model: ToxicityModel, config: ToxicityConfig):
    """A start function for a task; what it returns scores a list of texts.

    What a word adds to the mean is remembered by word. Each task gets one number for each bucket.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.gram_score, model.margin_bias))

    def start():
        grams, bias = shared.value
        known: dict[str, complex] = {}  # sum and number of the n-grams of a word, as one small object
        damp = [0.0] + [1 + math.log(n) for n in range(1, 4096)]

        def margin(content: str) -> float:
            total = weight = 0.0
            for word, n in Counter(words_of(content)).items():
                found = known.get(word)
                if found is None:
                    ids = subwords(word, config)
                    found = complex(grams[ids].sum(), len(ids))
                    if len(word) <= config.cache_chars:
                        known[word] = found
                w = damp[n] if n < 4096 else 1 + math.log(n)
                total += w * found.real
                weight += w * found.imag
            return total / (weight + config.blank) + bias

        def scores(texts: list[str]) -> list[float]:
            out = []
            for t in texts:
                out.append(1 / (1 + math.exp(-max(-700.0, min(700.0, margin(t))))))
                if len(known) > config.cache_words:
                    known.clear()
            return out

        return scores

    return start


def score(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text",
          config: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; only the text decides.

    A NULL text is scored like an empty one: by the bias alone. Rows with a NULL key have
    ``held_out`` NULL; repeated rows are scored like any other. There is no shuffle.
    """
    start = scorer(docs, model, config)

    def columns():
        scores = start()
        return lambda texts: (None, [scores(texts)])

    rows = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text"))
    scored = map_keyed(rows, columns, "score double")
    return scored.select(key, held_out(key).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: ToxicityModel, text: str = "text", config: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    """The rows whose own text scores below one half, all columns kept; the key plays no part."""
    start = scorer(docs, model, config)

    def judge():
        scores = start()
        return lambda texts: [s < 0.5 for s in scores(texts)]

    return keep_rows(docs, judge, text)
