"""Small DataFrame helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.session import apply_sql_defaults, cut_lineage, forget  # noqa: F401  (re-exported)

ARROW_ROWS = 1000   # texts per Arrow batch: bounds a Python worker's memory


def prepare(spark: SparkSession) -> None:
    """Session settings the operators rely on (runtime SQL settings only)."""
    apply_sql_defaults(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def col(name: str) -> Column:
    """A top-level column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def map_texts(df: DataFrame, fn: Callable[[pa.Array], dict[str, pa.Array]], fields: Sequence[T.StructField],
              text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """One output row per input row: the ``keep`` columns and what ``fn`` makes of the texts.

    ``fn`` sees the texts of one Arrow batch and returns one array per
    field.  Columns that are not named in ``keep`` never reach Python.  A
    kept column with the name of an output field gives way to the field.
    """
    prepare(df.sparkSession)
    new = {f.name for f in fields}
    keep = [c for c in keep if c not in new]
    src = df.select(*[col(c) for c in keep], col(text).cast("string").alias("__text"))
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = fn(b.column(b.num_columns - 1))
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keep))] + [out[n] for n in names],
                                             names=keep + names)

    kept = [T.StructField(c, df.schema[c].dataType, True) for c in keep]
    return src.mapInArrow(run, T.StructType(kept + list(fields)))


def filter_texts(df: DataFrame, fn: Callable[[pa.Array], dict[str, pa.Array]], flag: str, text: str = "text") -> DataFrame:
    """Rows of ``df`` (all columns, same schema) whose ``flag`` from ``fn`` is false."""
    import pyarrow.compute as pc
    prepare(df.sparkSession)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pc.invert(fn(b.column(at))[flag]))

    return df.mapInArrow(run, df.schema)


def field(name: str, kind: str) -> T.StructField:
    kinds = {"long": T.LongType(), "string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(),
             "binary": T.BinaryType(), "long[]": T.ArrayType(T.LongType()), "string[]": T.ArrayType(T.StringType())}
    return T.StructField(name, kinds[kind], True)


def count_words(text: Column) -> Column:
    """Runs of characters other than space and \\t..\\r; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
