"""Writers: columnar caches read through, JSON lines per batch, dimensions and CSV."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame], partition_by: list[str] | None = None) -> DataFrame:
    """What lies at path, written first if it isn't there (a write that broke off counts as absent)."""
    if not _exists(spark, path):
        w = build().write.mode("overwrite")
        (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return spark.read.parquet(path)


def write_jsonl(df: DataFrame, path: str, batch: str) -> None:
    """One gzipped folder per batch; writing a batch again replaces it, so that a repeated run changes nothing."""
    df.write.mode("overwrite").option("compression", "gzip").json(f"{path}/batch={batch}")


def write_dimension(df: DataFrame, path: str) -> None:
    """A small table as one file."""
    df.coalesce(1).write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, header: bool = True, compressed: bool = True) -> None:
    df.write.mode("overwrite").option("header", header).option("compression", "gzip" if compressed else "none").csv(path)
