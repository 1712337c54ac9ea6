"""Writers of result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from verstext.runtime import shuffles_go


def write_matches(df: DataFrame, path: str, files_per_source: int = 0) -> None:
    """Partitioned result table; only the partitions that occur in ``df`` are replaced."""
    if files_per_source:
        # a large source spreads over several writers instead of one
        df = df.repartition(F.col("source"), F.pmod(F.xxhash64("entry_id"), F.lit(files_per_source)))
    (
        df.write.option("partitionOverwriteMode", "dynamic")
        .partitionBy("source").mode("overwrite").parquet(path)
    )


def save_table(df: DataFrame, name: str, path: str, mode: str = "append") -> None:
    df.write.mode(mode).format("parquet").option("path", path).saveAsTable(name)


def replace_table(spark: SparkSession, new: str, name: str) -> None:
    """Let the table ``new`` take the place and the name of ``name``.

    The old table is put aside and dropped last. If a run ends before the new one has the name,
    a later call finishes the work: at every moment one of the two has all its rows.
    """
    aside = f"{name}_replaced"
    if spark.catalog.tableExists(new):
        if spark.catalog.tableExists(name):
            spark.sql(f"DROP TABLE IF EXISTS {aside}")
            spark.sql(f"ALTER TABLE {name} RENAME TO {aside}")
        spark.sql(f"ALTER TABLE {new} RENAME TO {name}")
    spark.sql(f"DROP TABLE IF EXISTS {aside}")


def export_tsv(df: DataFrame, path: str, label: str, text: str, doc: str, sent: str) -> None:
    """Headerless rows ``label, text, document, sentence`` separated by tabs."""
    flat = F.regexp_replace(F.col(text), r"[\t\r\n]+", " ")
    df.select(label, flat.alias(text), doc, sent).write.csv(path, sep="\t", quote="", escape="", emptyValue="")


def export_payload_json(df: DataFrame, path: str) -> None:
    """One JSON line for each pair. It holds the texts of two versions, nearly the same, which gzip keeps once."""
    with shuffles_go(df.sparkSession):
        df.write.json(path, compression="gzip")


def file_table(spark: SparkSession, path: str) -> DataFrame:
    """``file_path, file_size, rows`` of every data file below ``path``, empty ones included.

    Sizes and paths come from a listing of the files, without reading them; rows are counted by file.
    """
    sized = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    sized = sized.select(F.col("path").alias("file_path"), F.col("length").alias("file_size"))
    counted = spark.read.option("recursiveFileLookup", "true").parquet(path).groupBy(F.col("_metadata.file_path").alias("file_path")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    return sized.join(counted, "file_path", "left").withColumn("rows", F.coalesce("rows", F.lit(0).cast("long")))


def small_files(files: DataFrame, least_bytes: int | None = None, least_rows: int | None = None) -> DataFrame:
    """Files below a number of bytes or of rows; empty ones are always small."""
    small = F.col("rows") == 0
    if least_bytes is not None:
        small |= F.col("file_size") < least_bytes
    if least_rows is not None:
        small |= F.col("rows") < least_rows
    return files.where(small)


def rewrite_small(spark: SparkSession, source: str, target: str, least_rows: int, rows_per_file: int) -> None:
    """Rewrite only the small files of ``source``, as few files in ``target``; nothing is deleted.

    Large files keep their place: they and ``target`` together hold every row once.
    """
    # a list of files, as the one that Spark makes of a folder: only the small ones are read
    chosen = small_files(file_table(spark, source), least_rows=least_rows).where("rows > 0").select("file_path", "rows").collect()
    whole = spark.read.option("recursiveFileLookup", "true").parquet(source)
    rows = spark.read.schema(whole.schema).parquet(*[r.file_path for r in chosen]) if chosen else whole.limit(0)
    n = sum(r.rows for r in chosen)
    rows.repartition(max(1, -(-n // rows_per_file))).write.option("maxRecordsPerFile", rows_per_file).parquet(target)


def compact_outputs(spark: SparkSession, source: str, target: str, rows_per_file: int) -> None:
    """Rewrite many small files as few large ones in a new place; nothing is deleted.

    The number of files, and of the tasks that write them, follows from the number of rows. The files that a
    task reads become one, so no row is shuffled.
    """
    df = spark.read.parquet(source)
    files = max(1, -(-df.count() // rows_per_file))
    df.coalesce(files).write.option("maxRecordsPerFile", rows_per_file).parquet(target)
