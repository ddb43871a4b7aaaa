"""Stored tables: reading older layouts and replacing snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import ADDED_COLUMNS


def upgrade(df: DataFrame, table: str) -> DataFrame:
    """Add the columns an older table lacks, as typed NULLs."""
    missing = {c: t for c, t in ADDED_COLUMNS[table].items() if c not in df.columns}
    return df.withColumns({c: F.lit(None).cast(t) for c, t in missing.items()}) if missing else df


def write_snapshot(df: DataFrame, path: str, version: int) -> str:
    """Write a whole table as a new version; readers keep the old one meanwhile.

    A version folder is complete once its ``_SUCCESS`` marker exists, so a lost
    driver or executor never leaves a half-written table current.
    """
    target = f"{path}/version={version:012d}"
    df.write.mode("overwrite").parquet(target)
    return target


def complete_numbers(spark: SparkSession, path: str, key: str = "version") -> list[int]:
    """Numbers of the folders ``key=number`` that were written to the end, rising."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath() for s in fs.listStatus(root)]
    done = [
        int(p.getName().split("=")[1])
        for p in names
        if p.getName().startswith(f"{key}=") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    ]
    return sorted(done)


def current_version(spark: SparkSession, path: str) -> int | None:
    """Newest complete version, NULL when none was written."""
    return max(complete_numbers(spark, path), default=None)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    version = current_version(spark, path)
    return None if version is None else spark.read.parquet(f"{path}/version={version:012d}")
