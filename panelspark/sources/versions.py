"""Named tables that are replaced together: data folders first, a commit row last.

A commit writes every new table to a folder of its own and then one small
manifest folder that names the folders of all tables.  Readers take the
highest finished manifest, so a writer that stops in between leaves the old
version readable, and readers of the old version keep their files until that
version is pruned.  One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class VersionedTables:
    """Tables under ``base`` with numbered versions; the last ``keep`` versions stay."""

    def __init__(self, spark: SparkSession, base: str, keep: int = 2, fmt: str = "parquet"):
        self.spark, self.base, self.keep, self.fmt = spark, base.rstrip("/"), max(1, keep), fmt

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        """Finished versions, oldest first: manifest folders with their success mark."""
        fs, root = self._fs(f"{self.base}/manifest")
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory()]
        done = []
        for n in names:
            mark = self._fs(f"{self.base}/manifest/{n}/_SUCCESS")[1]
            if n.isdigit() and fs.exists(mark):
                done.append(int(n))
        return sorted(done)

    def manifest(self, version: int | None = None) -> tuple[dict[str, str], str | None]:
        """(folder of each table, tag) of a version, the last one by default; empty without any."""
        have = self.versions()
        if version is None and not have:
            return {}, None
        at = have[-1] if version is None else version
        if at not in have:
            raise KeyError(f"no finished version {at}")
        rows = self.spark.read.schema("name string, path string, tag string").json(f"{self.base}/manifest/{at:010d}").collect()
        tag = rows[0]["tag"] if rows else None
        return {r["name"]: r["path"] for r in rows if r["name"] is not None}, tag

    def read(self, name: str, version: int | None = None) -> DataFrame:
        paths, _ = self.manifest(version)
        if name not in paths:
            raise KeyError(f"no table {name}")
        return self.spark.read.format(self.fmt).load(paths[name])

    def commit(self, tables: Mapping[str, DataFrame], tag: str | None = None,
               partition_by: Mapping[str, Sequence[str]] | None = None) -> int:
        """Write ``tables`` and make them the current version; tables not named stay as they are.

        A commit whose ``tag`` is that of the current version has been made
        before and does nothing, so a replay is safe.
        """
        paths, last = self.manifest()
        have = self.versions()
        if tag is not None and have and last == tag:
            return have[-1]
        folder = self.new_folder()
        for name, df in tables.items():
            w = df.write.format(self.fmt)
            if partition_by and name in partition_by:
                w = w.partitionBy(*partition_by[name])
            w.save(f"{folder}/{name}")
            paths[name] = f"{folder}/{name}"
        return self.switch(paths, tag)

    def new_folder(self) -> str:
        """A fresh folder for data that a later ``switch`` names."""
        return f"{self.base}/data/{uuid.uuid4().hex[:16]}"

    def switch(self, paths: Mapping[str, str], tag: str | None = None) -> int:
        """Make these folders the current version."""
        have = self.versions()
        number = have[-1] + 1 if have else 1
        rows = [(n, p, tag) for n, p in sorted(paths.items())] or [(None, None, tag)]
        (self.spark.createDataFrame(rows, "name string, path string, tag string").coalesce(1)
         .write.mode("overwrite").json(f"{self.base}/manifest/{number:010d}"))   # over the leftovers of a failed try
        self._prune()
        return number

    def _prune(self) -> None:
        have = self.versions()
        old, kept = have[:-self.keep], have[-self.keep:]
        used = {p for v in kept for p in self.manifest(v)[0].values()}
        gone = {p for v in old for p in self.manifest(v)[0].values()} - used
        for path in [*sorted(gone), *[f"{self.base}/manifest/{v:010d}" for v in old]]:
            fs, p = self._fs(path)
            fs.delete(p, True)


class KeyedTable:
    """One versioned table in hash buckets of its key; an upsert rewrites only the buckets that it touches."""

    def __init__(self, spark: SparkSession, base: str, key: Sequence[str], buckets: int = 16, keep: int = 2):
        self.spark, self.key, self.buckets = spark, list(key), buckets
        self.versions = VersionedTables(spark, base, keep)

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_bucket", F.pmod(F.xxhash64(*[F.col(k) for k in self.key]), F.lit(self.buckets)).cast("int"))

    def _write(self, df: DataFrame, touched: Sequence[int] | None, tag: str | None) -> int:
        folder = self.versions.new_folder()
        # large buckets are split among tasks, small ones share one
        (self._bucketed(df).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(folder))
        fs, root = self.versions._fs(folder)
        names = [f.getPath().getName() for f in fs.listStatus(root)]
        written = [int(n.removeprefix("_bucket=")) for n in names if n.startswith("_bucket=")]   # none without rows
        paths = {} if touched is None else {n: p for n, p in self.versions.manifest()[0].items() if int(n) not in touched}
        paths.update({f"{b}": f"{folder}/_bucket={b}" for b in written})
        return self.versions.switch(paths, tag)

    def create(self, df: DataFrame) -> int:
        """Replace the whole table."""
        return self._write(df, None, None)

    def read(self, schema, buckets: Sequence[int] | None = None) -> DataFrame:
        """The current rows, of some buckets only if they are named."""
        paths = [p for n, p in self.versions.manifest()[0].items() if buckets is None or int(n) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def upsert(self, batch: DataFrame, schema, merge: Callable[[DataFrame, DataFrame], DataFrame], tag: str | None = None) -> int:
        """``merge(current rows, batch)`` for the buckets of the batch's keys; a tag that is the last one is a replay."""
        have = self.versions.versions()
        if tag is not None and have and self.versions.manifest()[1] == tag:
            return have[-1]
        touched = [r["_bucket"] for r in self._bucketed(batch).select("_bucket").distinct().collect()]   # at most ``buckets``
        if not touched:
            return self.versions.switch(self.versions.manifest()[0], tag)
        return self._write(merge(self.read(schema, touched), batch).select(*[f.name for f in schema.fields]), touched, tag)
