"""Bucketed tables under one manifest: only touched buckets are rewritten, one small file commits.

A store folder holds ``data/version=V/<table>/bucket=B`` and ``manifest/V.json``. A manifest
names the version of every bucket of every table, the folders of append-only tables, and
what has been folded in so far. A merge writes new folders first and its manifest last, by
one atomic rename; before that readers see nothing of it, and a second writer of the same
version fails instead of overwriting.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class StoreConflict(RuntimeError):
    """Another writer has committed this version."""


@dataclass(frozen=True)
class Manifest:
    """``buckets``: table → bucket → version; ``appended``: table → versions; ``folded``: the last batch within."""

    version: int = 0
    count: int = 64
    buckets: dict[str, dict[int, int]] = field(default_factory=dict)
    appended: dict[str, list[int]] = field(default_factory=dict)
    folded: int = -1

    def to_json(self) -> str:
        return json.dumps(self.__dict__, sort_keys=True)

    @staticmethod
    def of_json(text: str) -> Manifest:
        raw = json.loads(text)
        raw["buckets"] = {t: {int(b): v for b, v in own.items()} for t, own in raw["buckets"].items()}
        return Manifest(**raw)

    def after(self, folded: int, rewritten: dict[str, tuple[set[int], set[int]]], appended: list[str] = ()) -> Manifest:
        """The next version. ``rewritten``: table → (buckets touched, buckets that have rows now)."""
        version = self.version + 1
        buckets = {t: dict(own) for t, own in self.buckets.items()}
        for table, (touched, filled) in rewritten.items():
            kept = {b: v for b, v in buckets.get(table, {}).items() if b not in touched}
            buckets[table] = kept | dict.fromkeys(sorted(filled), version)
        more = {t: list(own) for t, own in self.appended.items()}
        for table in appended:
            more.setdefault(table, []).append(version)
        return Manifest(version, self.count, buckets, more, folded)


def bucket(count: int, *keys: Column | str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(count)).cast("int")


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _manifest_path(path: str, version: int) -> str:
    return f"{path}/manifest/{version:012d}.json"


def read_manifest(spark: SparkSession, path: str, count: int = 64) -> Manifest:
    """The newest committed manifest; an empty one with ``count`` buckets where there is none."""
    fs, Path = _fs(spark, path)
    folder = Path(f"{path}/manifest")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    done = sorted(n for n in names if n.endswith(".json") and not n.startswith((".", "_")))
    if not done:
        return Manifest(count=count)
    stream = fs.open(Path(f"{path}/manifest/{done[-1]}"))
    try:
        return Manifest.of_json(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def commit(spark: SparkSession, path: str, manifest: Manifest) -> None:
    """Make a version current. The rename is the one step that readers can see."""
    fs, Path = _fs(spark, path)
    target = Path(_manifest_path(path, manifest.version))
    draft = Path(f"{path}/manifest/.{manifest.version:012d}.{spark._jvm.java.util.UUID.randomUUID().toString()}")
    stream = fs.create(draft, True)
    try:
        stream.write(bytearray(manifest.to_json().encode()))
    finally:
        stream.close()
    if fs.exists(target) or not fs.rename(draft, target):
        fs.delete(draft, False)
        raise StoreConflict(f"version {manifest.version} of {path} exists")


def _table(path: str, version: int, table: str) -> str:
    return f"{path}/data/version={version:012d}/{table}"


def read_buckets(spark: SparkSession, path: str, manifest: Manifest, table: str, schema: str, numbers: set[int] | None = None) -> DataFrame:
    """Rows of a table, or of some of its buckets; the other buckets are not opened."""
    own = manifest.buckets.get(table, {})
    folders = [f"{_table(path, v, table)}/bucket={b}" for b, v in sorted(own.items()) if numbers is None or b in numbers]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read_appended(spark: SparkSession, path: str, manifest: Manifest, table: str, schema: str) -> DataFrame:
    folders = [_table(path, v, table) for v in manifest.appended.get(table, [])]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def write_buckets(df: DataFrame, path: str, manifest: Manifest, table: str, key: Column) -> set[int]:
    """Write rows to the next version, one folder for each bucket; returns the buckets that have rows."""
    target = _table(path, manifest.version + 1, table)
    df.withColumn("bucket", key).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)
    fs, Path = _fs(df.sparkSession, path)
    names = [s.getPath().getName() for s in fs.listStatus(Path(target))]
    return {int(n.split("=")[1]) for n in names if n.startswith("bucket=")}


def append(df: DataFrame, path: str, manifest: Manifest, table: str) -> str:
    df.write.mode("overwrite").parquet(_table(path, manifest.version + 1, table))
    return table
