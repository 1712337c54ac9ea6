"""Session helpers: cutting lineage and finding shared scratch space."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder; on a cluster an unset folder is
    an error, because no executor could read another machine's disk after a loss.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can read")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="verstext-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df`` in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Spark removes the shuffle files of each query that ends in here, instead of when the driver next collects garbage.

    Only for queries whose result is stored: nothing reads their shuffles again.
    """
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_GO)
        else:
            spark.conf.set(SHUFFLES_GO, before)


def materialise(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Later steps start from files with known sizes and only the columns they need, and a lost
    executor costs at most the steps after the write. The shuffles behind it go once it is written. The ``codec`` zstd finds texts again that stand up to some
    hundred KB apart, as those of several versions do.
    """
    path = scratch_path(df.sparkSession, label)
    with shuffles_go(df.sparkSession):
        df.write.options(**({"compression": codec} if codec else {})).parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def unsent(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that Spark never sends to the driver and to every task.

    Spark takes a table for as large as its files, less the columns left out. A match of some million rows is a few MB of
    zstd, and words are many more rows than the texts they are made of, so both pass for small.
    """
    return df.hint("merge")


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def list_path(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of whatever store holds it; none if there is no such folder."""
    target, store = _file_system(spark, path)
    return [s.getPath().getName() for s in store.listStatus(target)] if store.exists(target) else []


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder in whatever store holds it."""
    target, store = _file_system(spark, path)
    store.delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``materialise`` that no later step reads.

    Only steps whose own results are stored already may be behind them, as a lost executor makes
    Spark read the files again.
    """
    for t in tables:
        delete_path(t.sparkSession, t.stored_at)
