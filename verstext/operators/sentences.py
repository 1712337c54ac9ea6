"""Sentences, words and text shaping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from verstext.functions import text as tx
from verstext.operators.dealing import deal
from verstext.operators.frequent import join_by_word
from verstext.operators.nearest import in_pieces

DOC = ["entry_id", "version"]
MEAN_ROWS = 500
TEXT_BYTES = 16_000_000
NO_PLACE = -(1 << 62)


def split_sentences(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """One row per sentence, numbered from zero in the order of the text."""
    return df.select(*keys, F.posexplode(tx.sentence_pieces(text)).alias("sent_idx", "sentence"))


def split_paragraph_sentences(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Sentences with their paragraph; ``sent_idx`` runs on across paragraphs.

    The running number comes from nested arrays, so a text is shaped inside its own row.
    """
    paragraphs = F.split(F.col(text), tx.PARAGRAPH_BREAK, -1)
    nested = F.flatten(
        F.transform(
            paragraphs,
            lambda p, i: F.transform(
                F.split(p, tx.SENTENCE_BREAK, -1),
                lambda s: F.struct(i.alias("par_idx"), s.alias("sentence")),
            ),
        )
    )
    return df.select(*keys, F.posexplode(nested).alias("sent_idx", "_s")).select(
        *keys, F.col("_s.par_idx").alias("par_idx"), "sent_idx", F.col("_s.sentence").alias("sentence")
    )


def filter_boilerplate(df: DataFrame, sentence: str = "sentence", **rules) -> DataFrame:
    """Drop sentences that are site furniture."""
    return df.where(~tx.is_boilerplate(sentence, **rules))


def split_dateline(df: DataFrame, text: str, dashes=("—", "–"), places=None) -> DataFrame:
    """Add ``dateline`` and ``body``: a short place line is cut off the text."""
    lines = [tx.dateline(text, d, places=places) for d in dashes]
    found = F.coalesce(*lines)
    used = F.coalesce(*[F.when(line.isNotNull(), F.lit(d)) for line, d in zip(lines, dashes, strict=True)])
    rest = F.trim(F.substring(F.col(text), F.instr(F.col(text), used) + 1, F.length(F.col(text))))
    return df.withColumn("dateline", found).withColumn(
        "body", F.when(found.isNotNull(), rest).otherwise(F.col(text))
    )


def merge_dateline(df: DataFrame, dateline: str = "dateline", first: str = "sentence") -> DataFrame:
    """Put a dateline back in front of the first sentence."""
    return df.withColumn(first, F.concat_ws("—", F.col(dateline), F.col(first)))


def words(df: DataFrame, keys: list[str], sentence: str = "sentence") -> DataFrame:
    """One row per lower-cased token with its position and the word count of its sentence.

    The count is taken from the token array before it is spread into rows, so no window is needed. The array is
    made once: spread as it is, Spark would make it again to see whether it is empty.
    """
    counted = F.transform(F.array(tx.tokens(sentence)), lambda t: F.struct(F.size(t).alias("n"), t.alias("tokens")))
    return (
        df.select(*keys, F.explode(counted).alias("_list"))
        .select(*keys, F.col("_list.n").alias("num_words"), F.posexplode("_list.tokens").alias("word_idx", "token"))
        .withColumn("word", F.col("token"))
    )


def sentence_word_count(word_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Word count per sentence for word rows that come without one."""
    counts = word_rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_words"))
    return word_rows.drop("num_words").join(counts, keys)


def drop_null_vectors(word_rows: DataFrame, vector: str = "embedding") -> DataFrame:
    return word_rows.na.drop(subset=[vector])


def attach_vectors(word_rows: DataFrame, vectors: DataFrame, vec_id: str = "vec_id") -> DataFrame:
    """Word rows with the vector of their word id; rows without one keep NULL."""
    return join_by_word(word_rows, vectors.withColumnRenamed(vec_id, "word"), "word", "left")


def join_sentences(
    df: DataFrame, keys: list[str] = DOC, separator: str = tx.SENT_SEPARATOR, out: str = "sentences", count: str | None = None
) -> DataFrame:
    """Sentences of each document as one text, always in the order of ``sent_idx``, and their number as ``count``."""
    rows = df.select(*keys, F.coalesce(F.col("sent_idx").cast("long"), F.lit(NO_PLACE)).alias("_place"), "sentence")
    at, order = keys, ["_place", "sentence"]
    schema = StructType([*rows.schema.fields[: len(keys)], StructField(out, StringType()), StructField(count or "_count", LongType())])

    def work(table: pa.Table, last: bool):
        if table.num_rows == 0:
            return [], 0
        fresh = np.zeros(table.num_rows, bool)
        fresh[0] = True
        for k in keys:
            code = table.column(k).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
            fresh[1:] |= code[1:] != code[:-1]
        begins = np.append(np.flatnonzero(fresh), table.num_rows)
        if not last:
            begins = begins[:-1]  # the last document may go on
        texts = table.column("sentence").combine_chunks()
        there = np.append(0, np.cumsum(texts.is_valid().to_numpy(zero_copy_only=False)))
        lists = pa.ListArray.from_arrays(pa.array(there[begins].astype(np.int32)), texts.drop_null())
        whole = table.select(keys).take(pa.array(begins[:-1])).combine_chunks()
        columns = [*(c.combine_chunks() for c in whole.columns), pc.binary_join(lists, separator), pa.array(np.diff(begins))]
        return [pa.RecordBatch.from_arrays(columns, schema.names)] if len(lists) else [], int(begins[-1])

    if "version" in keys:
        # versions of an entry that lie together hold nearly the same text
        version = F.col("version").cast("long")
        rows = rows.withColumns({"_stretch": F.shiftright(version, 4), "_version": F.coalesce(version, F.lit(NO_PLACE))})
        at, order = [*[k for k in keys if k != "version"], "_stretch"], ["_version", *order]
    joined = deal(rows, at, order).mapInArrow(in_pieces(work, {"sentence": TEXT_BYTES}), schema)
    return joined if count else joined.drop("_count")


def ngram_counts(
    df: DataFrame, text: str, doc: str, sizes=(1, 2), min_df: int = 1, max_df: float = 1.0
) -> DataFrame:
    """Count and document frequency of content-token runs, kept within document-frequency bounds."""
    toks = tx.content_tokens(text)
    grams = F.flatten(F.array(*[tx.ngrams(F.col("_t"), n) for n in sizes]))
    n_docs = df.select(doc).distinct().agg(F.count(F.lit(1))).scalar()
    # dealt by text once, the runs of a text are counted where it lies
    per_doc = (
        df.select(doc, text).repartition(doc).select(doc, toks.alias("_t"))
        .select(doc, F.explode(grams).alias("ngram"))
        .groupBy("ngram", doc)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    counts = per_doc.groupBy("ngram").agg(
        F.sum("_n").alias("n"), F.count(F.lit(1)).alias("doc_freq")
    )
    return counts.where(
        (F.col("doc_freq") >= min_df) & (F.col("doc_freq") <= F.lit(max_df) * n_docs)
    )


def text_length_hist(df: DataFrame, text: str, width: int) -> DataFrame:
    """Number of texts per word-count bin."""
    n = tx.token_count(text)
    return df.groupBy((F.floor(n / width) * width).alias("bin_start")).agg(
        F.count(F.lit(1)).alias("n")
    )


def paragraph_frequency(df: DataFrame, text: str, k: int) -> DataFrame:
    """The k most frequent paragraphs; repeated ones are usually site furniture."""
    paragraphs = df.select(F.explode(F.split(F.col(text), tx.PARAGRAPH_BREAK, -1)).alias("paragraph"))
    return (
        paragraphs.groupBy("paragraph").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "paragraph").limit(k)
    )


def dateline_counts(df: DataFrame, text: str, dash: str, max_tokens: int = 7) -> DataFrame:
    """Texts before the first dash that are shorter than ``max_tokens`` tokens, with counts."""
    head = F.trim(F.substring_index(F.col(text), dash, 1))
    return (
        df.where(F.col(text).contains(dash))
        .select(head.alias("dateline"))
        .where(tx.token_count("dateline") < max_tokens)
        .groupBy("dateline").agg(F.count(F.lit(1)).alias("n"))
    )


def mean_vector(word_rows: DataFrame, vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of the word vectors of a sentence, one row per (keys, dimension).

    A sentence repeats words, so equal words are counted before the vectors are attached. The vectors of a
    sentence come together as they are and are added up there, not as a row for each word and dimension.
    """
    bags = word_rows.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("_c"))
    known = join_by_word(bags, vectors.withColumnRenamed("vec_id", "word"), "word")
    lists = known.groupBy(*keys).agg(F.collect_list(F.struct(F.col("_c").alias("c"), "vector")).alias("_own"))
    rows = lists.select(*keys, F.transform("_own", lambda w: w["c"]).alias("_c"), F.transform("_own", lambda w: w["vector"]).alias("_v"))
    schema = StructType([*rows.schema.fields[: len(keys)], StructField("dim", IntegerType()), StructField("value", DoubleType())])

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, MEAN_ROWS):
                piece = batch.slice(at, MEAN_ROWS)
                counts, lists = piece.column("_c"), piece.column("_v")
                row = np.repeat(np.arange(piece.num_rows), counts.value_lengths().to_numpy(zero_copy_only=False))
                words = lists.flatten()
                size = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                if not size.sum():
                    continue
                most = int(size.max())
                dim = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                cell = np.repeat(row, size) * most + dim
                count = np.repeat(counts.flatten().to_numpy(zero_copy_only=False), size)
                values = words.flatten()
                known = values.is_valid().to_numpy(zero_copy_only=False)
                part = np.where(known, values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64), 0.0) * count
                cells = piece.num_rows * most
                number = np.bincount(cell, count, minlength=cells)
                used = np.flatnonzero(number > 0)
                total = np.bincount(cell, part, minlength=cells)[used] / number[used]
                none = np.bincount(cell, known, minlength=cells)[used] == 0
                whole = piece.select(keys).take(pa.array(used // most))
                columns = [*whole.columns, pa.array((used % most).astype(np.int32)), pa.array(total, mask=none)]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.mapInArrow(mean, schema)
