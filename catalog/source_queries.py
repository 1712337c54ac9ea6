"""Readers and writers: each query writes derived rows to shared scratch space and reads them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog.ctes import with_ctes
from catalog.registry import query
from catalog.views import CONFIG, Views
from verstext.operators import match
from verstext.plans import payload
from verstext.sources import readers, schema, writers


@query("scan_versions", with_ctes("entryversion", """
    SELECT source, entry_id, version, title FROM entryversion
    WHERE entry_id NOT IN (SELECT doc_id FROM labels)"""))
def scan_versions(v: Views):
    path = v.scratch("versions")
    v.entryversion.repartition(F.col("entry_id")).write.parquet(f"{path}/chunk_0")
    done = v.labels_table.select(F.col("doc_id").alias("entry_id"))
    df = readers.scan_versions(v.spark, f"{path}/chunk_*", schema.ENTRYVERSION, done)
    return df.select("source", "entry_id", "version", "title")


@query("scan_csv", with_ctes("sentences", """
    SELECT source, entry_id, version, sent_idx, md5(sentence) AS sentence_md5 FROM sentences"""))
def scan_csv(v: Views):
    path = v.scratch("csv")
    v.sentences.write.csv(path, header=True, quoteAll=True, quote='"', escape='"', compression="gzip")
    df = readers.scan_csv(v.spark, path, schema.SENTENCES)
    return df.select("source", "entry_id", "version", "sent_idx", F.md5(F.col("sentence")).alias("sentence_md5"))


@query("scan_json_tolerant", """
    SELECT conv_id AS entry_id, turn AS version, role, md5(text) AS text_md5, FALSE AS is_corrupt
    FROM conversations
    UNION ALL SELECT NULL, NULL, NULL, NULL, TRUE""")
def scan_json_tolerant(v: Views):
    path = v.scratch("json")
    rows = v.conversations.select(
        F.concat(F.to_json(F.struct(F.col("conv_id").alias("entry_id"), F.col("turn").alias("version"), "role", "text")),
                 F.lit(",")).alias("value")
    )
    rows.write.text(path)
    v.spark.createDataFrame([("[",), ('{"entry_id": 1, ',), ("]",)], "value string").write.mode("append").text(path)
    df = readers.scan_json_tolerant(v.spark, path, "entry_id long, version long, role string, text string")
    return df.select("entry_id", "version", "role", F.md5(F.col("text")).alias("text_md5"),
                     F.col("_corrupt_record").isNotNull().alias("is_corrupt"))


@query("write_matches", with_ctes("matched entryversion", """
    SELECT source, m.entry_id, version_x, sent_idx_x, sent_idx_y,
           round(avg_sentence_distance_x, 6) AS distance_x
    FROM matched m JOIN (SELECT DISTINCT entry_id, source FROM entryversion) s ON s.entry_id = m.entry_id"""))
def write_matches(v: Views):
    path = v.scratch("matched")
    sources = v.documents.select(F.col("doc_id").alias("entry_id"), "source")
    writers.write_matches(v.matched.join(sources, "entry_id"), path, files_per_source=4)
    return readers.scan_matches(v.spark, path).select(
        "source", "entry_id", "version_x", "sent_idx_x", "sent_idx_y",
        F.round("avg_sentence_distance_x", 6).alias("distance_x"),
    )


@query("save_table", with_ctes("sentences", """
    SELECT source, entry_id, version, sent_idx, md5(sentence) AS sentence_md5 FROM
    (SELECT * FROM sentences UNION ALL SELECT * FROM sentences WHERE sent_idx = 0)"""))
def save_table(v: Views):
    name, path = f"split_sentences_{uuid.uuid4().hex}", v.scratch("table")
    writers.save_table(v.sentences, name, path, "overwrite")
    writers.save_table(v.sentences.where("sent_idx = 0"), name, path, "append")
    return _rows(v.spark.table(name))


@query("replace_table", with_ctes("sentences", """
    SELECT source, entry_id, version, sent_idx, md5(sentence) AS sentence_md5 FROM sentences"""))
def replace_table(v: Views):
    name = f"sentences_{uuid.uuid4().hex}"
    writers.save_table(v.sentences.where("sent_idx = 0"), name, v.scratch("table"), "overwrite")
    writers.save_table(v.sentences, f"{name}_v2", v.scratch("table"), "overwrite")
    writers.replace_table(v.spark, f"{name}_v2", name)
    return v.spark.table(name).select("source", "entry_id", "version", "sent_idx", F.md5(F.col("sentence")).alias("sentence_md5"))


@query("export_tsv", with_ctes("sentences", r"""
    SELECT source AS label, regexp_replace(sentence, '[\t\r\n]+', ' ', 'g') AS text,
           CAST(entry_id AS VARCHAR) AS doc_id, CAST(sent_idx AS VARCHAR) AS sent_id FROM sentences"""))
def export_tsv(v: Views):
    path = v.scratch("tsv")
    rows = v.sentences.select(F.col("source").alias("label"), F.col("sentence").alias("text"),
                              F.col("entry_id").alias("doc_id"), F.col("sent_idx").alias("sent_id"))
    writers.export_tsv(rows, path, "label", "text", "doc_id", "sent_id")
    parts = F.split("value", "\t")
    return v.spark.read.text(path).select(
        *[parts[i].alias(n) for i, n in enumerate(["label", "text", "doc_id", "sent_id"])]
    )


PAYLOAD_SQL = """
    , n AS (SELECT entry_id, version AS version_x, 0 AS side, version, sent_idx, sentence, source FROM sentences
            UNION ALL SELECT entry_id, version - 1, 1, version, sent_idx, sentence, source FROM sentences),
    nodes AS (SELECT source, entry_id, version_x, count(*) AS num_nodes,
                     md5(string_agg(version || ':' || sent_idx || ':' || sentence, '|' ORDER BY version, sent_idx)) AS nodes_md5
              FROM n GROUP BY ALL HAVING min(side) < max(side)),
    arcs AS (SELECT entry_id, version_x, count(*) AS num_arcs, string_agg(sent_idx_x || '-' || sent_idx_y, ',' ORDER BY sent_idx_x, sent_idx_y) AS arcs
             FROM matched WHERE sent_idx_x IS NOT NULL AND sent_idx_y IS NOT NULL GROUP BY ALL)
    SELECT source, entry_id, CAST(version_x AS INTEGER) AS version_x, num_nodes, nodes_md5, coalesce(num_arcs, 0) AS num_arcs, coalesce(arcs, '') AS arcs
    FROM nodes LEFT JOIN arcs USING (entry_id, version_x)"""


def _payload_view(df):
    node = F.transform("nodes", lambda n: F.concat_ws(":", n["version"].cast("string"), n["sent_idx"].cast("string"), n["sentence"]))
    arc = F.transform("arcs", lambda a: F.concat_ws("-", a["sent_idx_x"].cast("string"), a["sent_idx_y"].cast("string")))
    return df.select(
        "source", "entry_id", "version_x", F.size("nodes").cast("long").alias("num_nodes"),
        F.md5(F.array_join(node, "|").cast("binary")).alias("nodes_md5"), F.size("arcs").cast("long").alias("num_arcs"),
        F.array_join(arc, ",").alias("arcs"),
    )


@query("export_payload_json", with_ctes("sentences matched", PAYLOAD_SQL))
def export_payload_json(v: Views):
    path = v.scratch("payload")
    # made twice from the documents, so that they do not lie beside the exported texts
    sentences = v.make_sentences()
    matched = v.stored("matched", lambda: match.match_bidirectional(sentences, config=CONFIG))
    df = payload.payload_nodes_arcs(matched, sentences)
    writers.export_payload_json(df, path)
    return _payload_view(v.spark.read.schema(df.schema).json(path))


@query("payload_nodes_arcs", with_ctes("sentences matched", PAYLOAD_SQL))
def payload_nodes_arcs(v: Views):
    return _payload_view(payload.payload_nodes_arcs(v.matched, v.sentences))


ROWS_SQL = "SELECT source, entry_id, version, sent_idx, md5(sentence) AS sentence_md5 FROM sentences"
LEAST_ROWS = 2_500
DAY_ROWS = 1_000_000


def _rows(df):
    return df.select("source", "entry_id", "version", "sent_idx", F.md5(F.col("sentence")).alias("sentence_md5"))


def _files_by_day(v: Views) -> str:
    """One file for each of 64 days, by entry, and one more without rows; days are of very different size.

    A day of more than ``DAY_ROWS`` rows is several large files, so that no task holds it alone.
    """
    path = v.scratch("days")
    day = F.floor(F.pow(F.col("entry_id") % 64, F.lit(2)) / 64).cast("int")
    rows = {r.day: r.n for r in v.sentences.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [max(1, rows.get(d, 0) // DAY_ROWS) for d in range(64)]
    begin = F.element_at(F.array(*[F.lit(sum(parts[:d])) for d in range(64)]), day + 1)
    part = F.pmod(F.xxhash64("entry_id", "version", "sent_idx"), F.element_at(F.array(*[F.lit(p) for p in parts]), day + 1))
    v.sentences.repartitionById(sum(parts), (begin + part).cast("int")).write.parquet(path)
    v.sentences.limit(0).coalesce(1).write.mode("append").parquet(path)
    return path


@query("small_files", with_ctes("sentences", f"""
    , d AS (SELECT (entry_id % 64) * (entry_id % 64) // 64 AS day, count(*) AS rows FROM sentences GROUP BY 1)
    SELECT rows, count(*) AS files, TRUE AS has_size FROM (SELECT rows FROM d WHERE rows < {LEAST_ROWS} UNION ALL SELECT 0) GROUP BY rows"""))
def small_files(v: Views):
    files = writers.small_files(writers.file_table(v.spark, _files_by_day(v)), least_rows=LEAST_ROWS)
    return files.groupBy("rows").agg(F.count(F.lit(1)).alias("files"), F.min(F.col("file_size") > 0).alias("has_size"))


@query("rewrite_small", with_ctes("sentences", f"{ROWS_SQL}"))
def rewrite_small(v: Views):
    """The files that stay and the rewritten ones together hold every row once."""
    path, target = _files_by_day(v), v.scratch("rewritten")
    writers.rewrite_small(v.spark, path, target, LEAST_ROWS, rows_per_file=100_000)
    small = writers.small_files(writers.file_table(v.spark, path), least_rows=LEAST_ROWS).select("file_path")
    old = v.spark.read.schema(schema.SENTENCES).parquet(path).withColumn("file_path", F.col("_metadata.file_path"))
    # at most one small file for each day
    stay = old.join(F.broadcast(small), "file_path", "left_anti").drop("file_path")
    return _rows(stay.unionByName(v.spark.read.schema(schema.SENTENCES).parquet(target)))


@query("compact_outputs", with_ctes("sentences", ROWS_SQL))
def compact_outputs(v: Views):
    small, large = v.scratch("small"), v.scratch("large")
    v.sentences.write.option("maxRecordsPerFile", 10_000).parquet(small)
    writers.compact_outputs(v.spark, small, large, rows_per_file=1_000_000)
    return _rows(v.spark.read.schema(schema.SENTENCES).parquet(large))


@query("source_from_path", with_ctes("entryversion", """
    SELECT entry_id, version, source AS path_source FROM entryversion"""))
def source_from_path(v: Views):
    path = v.scratch("by_source")
    v.entryversion.select("source", "entry_id", "version").write.partitionBy("source").parquet(path)
    return readers.source_from_path(v.spark.read.parquet(path)).select("entry_id", "version", "path_source")


@query("dump_url_pairs", with_ctes("entryversion", """
    SELECT a.id AS old_id, b.id AS new_id, a.archive_url AS old_url, b.archive_url AS new_url
    FROM entryversion a JOIN entryversion b ON a.entry_id = b.entry_id AND b.version = a.version + 1
    WHERE a.archive_url IS NOT NULL AND b.archive_url IS NOT NULL"""))
def dump_url_pairs(v: Views):
    links = match.adjacent_versions(v.entryversion, ["id"]).select(
        F.col("id_x").alias("old_id"), F.col("id_y").alias("new_id")
    )
    return readers.dump_url_pairs(links, v.entryversion).select("old_id", "new_id", "old_url", "new_url")
