"""File sources and sinks (A2-A4, A6-A8) and exact file-order line numbers.

Writes go to the shared checkpoint folder's scratch area (``scratch_path``)
or a caller-given path; never to a machine-local temp folder.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.session import cut_lineage, scratch_path, sized_broadcast
from panelspark.sources.versions import VersionedTables


class MissingColumnsError(ValueError):
    pass


def with_line_numbers(df: DataFrame, out: str = "line_no") -> DataFrame:
    """0-based position of each row in file order, computed without a global window.

    File order = (file path, split start, position inside the split).  The
    position inside a split comes from ``monotonically_increasing_id`` (a
    split is read by one task, in order); per-split row counts form a table
    bounded by the number of splits, whose prefix sums give each split's
    offset.  Must be applied directly on a file-source DataFrame.
    """
    x = df.select("*", F.col("_metadata.file_path").alias("_fp"),
                  F.col("_metadata.file_block_start").alias("_fb"),
                  F.monotonically_increasing_id().alias("_mid"))
    splits = x.groupBy("_fp", "_fb").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_mid0"))
    w = Window.orderBy("_fp", "_fb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("_fp", "_fb", "_mid0", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    # one row per input split (bounded by the file layout, not by the rows): broadcast only when
    # the size check proves it small, otherwise AQE picks the join
    y = x.join(sized_broadcast(offsets), ["_fp", "_fb"])
    return y.select(*df.columns, (F.col("_off") + F.col("_mid") - F.col("_mid0")).alias(out))


MOST_LINES = 100_000   # of one record; more is an unclosed quote


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, key, at, odd, blank, line): every line; ``odd``: it has an odd number of quotes."""
    line = F.col("value")
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.xxhash64("_metadata.file_path", "_metadata.file_block_start").alias("key"), F.monotonically_increasing_id().alias("at"),
        ((F.char_length(line) - F.char_length(F.replace(line, F.lit('"'), F.lit("")))) % 2).cast("int").alias("odd"),
        (F.trim(F.regexp_replace(line, "\r$", "")) == "").alias("blank"), line.alias("line"))


def _runs(keys):
    """(first, end) of each run of equal keys."""
    import numpy as np
    cut = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
    return [(a, b) for a, b in zip(cut, cut[1:]) if a < b]


def _count_splits(batches):
    """A row per split: its quotes' parity, the records that begin in it, if it begins outside and if inside a quoted cell, and its odd lines."""
    import numpy as np
    import pyarrow as pa
    have: dict[int, list] = {}
    for b in batches:
        keys, odd, blank = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
        for start, end in _runs(keys):
            at = have.setdefault(int(keys[start]), [b.column(0)[start].as_py(), b.column(1)[start].as_py(), 0, 0, 0, 0])
            inner = (at[2] + np.cumsum(odd[start:end]) - odd[start:end]) % 2 == 1
            full = ~blank[start:end]
            at[3] += int((full & ~inner).sum())
            at[4] += int((full & inner).sum())
            at[5] += int(odd[start:end].sum())
            at[2] = at[5] % 2
    if have:
        columns = [list(have), *zip(*have.values())]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "file", "split", "odd", "outside", "inside", "quoted"])


def _numbered_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, text): the records of every file in order, from 0; quoted line breaks do not end a record.

    ``file`` is the place of the file among all of them, by name.  A line
    lies inside a quoted cell if an odd number of quotes stands before it in
    its file.  A first pass counts quotes and records per split; the prefix
    sums of these, a row per split, let every task number the lines that it
    reads as they come.  Only records of several lines are put together by a
    shuffle.  Blank lines between records are no records.
    """
    x = _lines(spark, path)
    splits = x.select("file", "split", "key", "odd", "blank").mapInArrow(
        _count_splits, "key long, file string, split long, odd long, outside long, inside long, quoted long").collect()   # a row per split
    starts, number, last = {}, -1, None
    for r in sorted(splits, key=lambda r: (r["file"], r["split"])):
        if r["file"] != last:
            last, number, quotes, records = r["file"], number + 1, 0, 0
        starts[r["key"]] = (number, quotes, records)
        records += r["inside"] if quotes else r["outside"]
        quotes = (quotes + r["odd"]) % 2
    told = spark.sparkContext.broadcast(starts)

    def number_lines(batches):
        import numpy as np
        import pyarrow as pa
        seen: dict[int, list] = {}
        for b in batches:
            keys, odd, blank = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 3, 4))
            file, record, inner = np.zeros(len(keys), np.int32), np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
            for start, end in _runs(keys):
                at = seen.setdefault(int(keys[start]), list(told.value[int(keys[start])]))
                file[start:end] = at[0]
                inner[start:end] = (at[1] + np.cumsum(odd[start:end]) - odd[start:end]) % 2 == 1
                begins = ~inner[start:end] & ~blank[start:end]
                record[start:end] = at[2] + np.cumsum(begins) - 1
                at[1], at[2] = (at[1] + int(odd[start:end].sum())) % 2, at[2] + int(begins.sum())
            out = pa.RecordBatch.from_arrays([pa.array(file), pa.array(record), b.column(1), b.column(2), pa.array(~inner & (odd == 0)), b.column(5)],
                                             names=["file", "record", "split", "at", "whole", "line"])
            yield out.filter(pa.array(inner | ~blank))

    x = x.select("key", "split", "at", "odd", "blank", "line").mapInArrow(
        number_lines, "file int, record long, split long, at long, whole boolean, line string")
    plain = lambda c: F.regexp_replace(c, "\r$", "").alias("text")
    one = x.filter("whole").select("file", "record", plain("line"))
    if not any(r["quoted"] for r in splits):
        return one   # every record is a line: nothing to put together
    whole = F.expr("array_join(transform(sort_array(collect_list(struct(split, at, line))), s -> s.line), '\n')")
    many = F.count(F.lit(1)) > MOST_LINES
    text = F.when(many, F.raise_error(F.concat(F.lit(f"a quote is not closed in {path}, file "), F.first("file").cast("string"))).cast("string")).otherwise(whole)
    more = x.filter("not whole").groupBy("file", "record").agg(text.alias("text"))
    return one.unionByName(more.select("file", "record", plain("text")))


def read_csv_strings(spark: SparkSession, path: str, required: Sequence[str], line_col: str | None = "line_no",
                     header: bool = True) -> DataFrame:
    """Read every cell as a string; fail before any row if required columns are missing (A2).

    The first record of every file is the header and must be the same in all
    of them.  Cells may hold quoted line breaks and doubled quotes; an empty
    cell is an empty string, a missing one null.  ``line_col`` numbers the
    records after the header from 0, in the order of files and places.
    """
    import csv
    records = _numbered_records(spark, path)
    if header:
        heads = [r["text"] for r in records.filter("record = 0").select("text").distinct().limit(2).collect()]
        if len(heads) > 1:
            raise ValueError("the files do not have the same header")
        names = next(csv.reader([heads[0]])) if heads else []
        records = records.filter("record > 0").withColumn("record", F.col("record") - 1)
    else:
        names = list(required)
    missing = [c for c in required if c not in names]
    if missing:
        raise MissingColumnsError(f"CSV is missing required columns: {', '.join(missing)}")
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    cells = F.from_csv("text", F.lit(schema), {"escape": '"', "emptyValue": "", "nullValue": "\u0000", "lineSep": "\u0001",
                                               "maxCharsPerColumn": "-1", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})
    # the parser gives null for an empty cell and for one that is not there: commas outside quotes tell them apart
    there = F.size(F.split(F.regexp_replace("text", '"[^"]*"', ""), ",", -1))
    x = records.select("file", "record", cells.alias("c"), there.alias("_there"))
    own = [F.when(F.col("_there") > j, F.coalesce(F.col("c")[n], F.lit(""))).alias(n) for j, n in enumerate(names)]
    if not line_col:
        return x.select(*own)
    per = x.groupBy("file").agg((F.max("record") + 1).alias("_n"))   # a row per file
    off = per.select("file", F.coalesce(F.sum("_n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    return x.join(sized_broadcast(off), "file").select(*own, (F.col("record") + F.col("_off")).alias(line_col))


def write_csv(df: DataFrame, path: str, order: Sequence[str] | None = None) -> str:
    """Write a header CSV folder; ``order`` range-partitions so part files follow key order."""
    out = df.orderBy(*order) if order else df
    out.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_csv_snapshot(spark: SparkSession, tables: Mapping[str, DataFrame], base: str | None = None,
                       seed: int | None = None, order: Mapping[str, Sequence[str]] | None = None) -> str:
    """One CSV folder per table plus a metadata JSON (seed, sizes, time) (A3)."""
    base = base or scratch_path(spark, "snapshot")
    sizes = {}
    for name, df in tables.items():
        write_csv(df, f"{base}/{name}", (order or {}).get(name))
        sizes[name] = spark.read.option("header", True).csv(f"{base}/{name}").count()
    meta = {"seed": seed, "sizes": sizes, "generated_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())}
    spark.createDataFrame([(json.dumps(meta),)], ["value"]).coalesce(1).write.mode("overwrite").text(f"{base}/_metadata")
    return base


def replace_tables(spark: SparkSession, tables: Mapping[str, DataFrame], base: str,
                   partition_by: Mapping[str, Sequence[str]] | None = None) -> VersionedTables:
    """Idempotent full reload of all tables at once (A4): written aside, then switched together.

    A reload that fails in between leaves the old tables in place; ids are
    kept as they are.
    """
    store = VersionedTables(spark, base)
    store.commit(tables, partition_by=partition_by)
    return store


def replace_by_key(base: DataFrame, new: DataFrame, key: Sequence[str] | str) -> DataFrame:
    """Rows whose key is in ``new`` are replaced, the others kept (A6); idempotent."""
    keys = [key] if isinstance(key, str) else list(key)
    return base.join(new.select(*keys), keys, "left_anti").unionByName(new)


def write_replace_by_key(spark: SparkSession, base_path: str, new: DataFrame, key, out_path: str | None = None,
                         fmt: str = "parquet") -> str:
    """Apply ``replace_by_key`` and write to a *new* path (never overwrite what is being read)."""
    base = spark.read.format(fmt).load(base_path)
    out_path = out_path or scratch_path(spark, "replaced")
    replace_by_key(base, new, key).write.mode("overwrite").format(fmt).save(out_path)
    return out_path


def append_log(df: DataFrame, path: str, payload_cols: Iterable[str], fmt: str = "parquet",
               ts_col: str = "logged_at") -> None:
    """Append records with a JSON payload and a timestamp."""
    cols = list(payload_cols)
    rec = df.select(*[c for c in df.columns if c not in cols],
                    F.to_json(F.struct(*cols)).alias("payload"), F.current_timestamp().alias(ts_col))
    rec.write.mode("append").format(fmt).save(path)


def write_report(df: DataFrame, path: str) -> None:
    """Nested metrics / fairness / importance report as JSON lines."""
    df.write.mode("overwrite").json(path)
