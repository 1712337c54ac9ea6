"""Local session for tests, checks and the benchmark."""

import os

from pyspark.sql import SparkSession


def local_session(cores: str = "8", memory: str = "12g") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("verstext")
        .config("spark.sql.shuffle.partitions", os.environ.get("SHUFFLE", "16"))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        # hash join where every shuffled partition is measured to be small, sort-merge join elsewhere
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "32m")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
