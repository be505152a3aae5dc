"""Table loading and null normalisation (A1, A5)."""

from __future__ import annotations

import os
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                 "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Tables(Mapping):
    """Lazy ``name -> DataFrame`` map over a folder of ``{name}.parquet`` tables (A1).

    Nothing is read until a frame is used; Catalyst then prunes columns and
    pushes filters into each scan, so "load everything" costs nothing.
    """

    def __init__(self, spark: SparkSession, base: str, names: Iterable[str] = DRIVER_TABLES,
                 fmt: str = "parquet"):
        self.spark, self.base, self.fmt = spark, base, fmt
        self._names = tuple(names)
        self._cache: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._names:
            raise KeyError(name)
        if name not in self._cache:
            path = os.path.join(self.base, f"{name}.{self.fmt}")
            df = self.spark.read.format(self.fmt).load(path)
            self._cache[name] = df
        return self._cache[name]

    def __iter__(self):
        return iter(self._names)

    def __len__(self) -> int:
        return len(self._names)


def load_tables(spark: SparkSession, base: str, names: Iterable[str] = DRIVER_TABLES,
                fmt: str = "parquet") -> Tables:
    return Tables(spark, base, names, fmt)


def load_jdbc_tables(spark: SparkSession, url: str, names: Iterable[str],
                     properties: Mapping[str, str] | None = None,
                     partitioning: Mapping[str, tuple[str, int, int, int]] | None = None) -> dict[str, DataFrame]:
    """Same contract over a JDBC database; big tables read in parallel ranges.

    ``partitioning[name] = (column, lower, upper, num_partitions)``.
    """
    out = {}
    for name in names:
        reader = spark.read.format("jdbc").option("url", url).option("dbtable", name)
        for k, v in (properties or {}).items():
            reader = reader.option(k, v)
        if partitioning and name in partitioning:
            col, lo, hi, n = partitioning[name]
            reader = (reader.option("partitionColumn", col).option("lowerBound", lo)
                      .option("upperBound", hi).option("numPartitions", n))
        out[name] = reader.load()
    return out


def normalise_nulls(df: DataFrame, int_columns: Iterable[str] = ()) -> DataFrame:
    """NaN -> NULL in every floating column; declared int columns cast back (A5).

    A column that picked up NaN on the way in becomes double; the declared
    integer columns are restored to int after the NaNs are nulled.
    """
    ints = set(int_columns)
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
            if f.name in ints:
                c = c.cast("int")
        elif f.name in ints:
            c = c.cast("int")
        cols.append(c.alias(f.name))
    return df.select(*cols)
