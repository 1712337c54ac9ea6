"""Readers of the file forms in which article tables arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from verstext.sources.schema import MATCHED_BY_SOURCE


def scan_versions(spark: SparkSession, path: str, schema, done: DataFrame | None = None) -> DataFrame:
    """Numbered parquet chunks of one source without the entries that are already done."""
    df = spark.read.schema(schema).parquet(path)
    if done is not None:
        df = df.join(done.select("entry_id").distinct(), "entry_id", "left_anti")
    return df


def scan_csv(spark: SparkSession, path: str, schema, multi_line: bool = True) -> DataFrame:
    """CSV files, compressed or not, with quoted texts that may hold line breaks.

    A file with such breaks is read by one task. ``multi_line=False`` lets Spark split plain files
    whose texts have none; gzip files cannot be split.
    """
    return spark.read.schema(schema).csv(path, header=True, quote='"', escape='"', multiLine=multi_line)


def scan_json_tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines or the lines of a JSON array; brackets and trailing commas are ignored.

    A line that cannot be read keeps its text in ``_corrupt_record``.
    """
    lines = spark.read.text(path).where(~F.trim("value").isin("[", "]", ""))
    bare = F.regexp_replace("value", r",\s*$", "")
    parsed = F.from_json(
        bare, f"{schema}, _corrupt_record string",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"},
    )
    return lines.select(parsed.alias("_row")).select("_row.*")


def scan_matches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MATCHED_BY_SOURCE).parquet(path)


def source_from_path(df: DataFrame) -> DataFrame:
    """Source name taken from the folder ``source=<name>`` of each row's file."""
    return df.withColumn("path_source", F.regexp_extract(F.input_file_name(), r"source=([^/]+)/", 1))


def dump_url_pairs(links: DataFrame, versions: DataFrame) -> DataFrame:
    """Archive addresses of both ends of a link, where both exist."""
    side = versions.where("archive_url IS NOT NULL").select("id", "archive_url")
    old = side.select(F.col("id").alias("old_id"), F.col("archive_url").alias("old_url"))
    new = side.select(F.col("id").alias("new_id"), F.col("archive_url").alias("new_url"))
    return links.join(old, "old_id").join(new, "new_id")
