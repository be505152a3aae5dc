"""Mixing sources to target weights by weighted fair queueing.

Every document (and every repeat of it) is a packet of its source's queue.
In a queue the documents stand in shuffled order, and a packet's virtual
finish time is the source's words up to and including it, divided by the
source's target.  All packets are range-sorted by finish time and the line is
cut where the total budget is used up.  Up to the cut a source has had its
share of the line to within its own longest document, and the words taken by
all sources fall short of the budget by less than the longest packet, so a
source's taken words differ from its target by no more than the sum of the two.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.frames import col, count_words, cut_lineage, prepare

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
ROWS_PER_BUCKET = 20_000


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size), one row per source.

    Sources take the weights in turn by code point, null last.  The targets
    share the sum of all sizes by weight; a source whose share exceeds
    ``max_repeats`` times its size is held there and the excess is shared out
    again, until none is above.  The rounds pass three numbers through the
    driver each; the table itself (a row per source) stays distributed.
    """
    spark = sizes.sparkSession
    # rank by counting the sources of earlier range partitions, then inside the partition
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("source").isNull().asc(), F.col("source").asc()]
    ranged = cut_lineage(sizes.withColumn("_null", F.col("source").isNull()).repartitionByRange(n, "_null", "source")
                         .withColumn("_pid", F.spark_partition_id()), "mix-sources")
    before = (ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
              .select("_pid", F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(
                  Window.unboundedPreceding, -1)), F.lit(0)).alias("_before")))
    rank = F.row_number().over(Window.partitionBy("_pid").orderBy(*order)) - 1 + F.col("_before")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    t = cut_lineage(ranged.join(F.broadcast(before), "_pid").select(
        "source", "source_size", w.alias("weight"),
        (F.col("source_size") * F.lit(float(max_repeats))).alias("_most")), "mix-weights")
    total = t.agg(F.sum("source_size")).first()[0] or 0
    # a source is held once its limit per weight lies below the level; levels only rise
    level, held = None, -1
    while total:
        full = F.col("_most") < F.col("weight") * F.lit(level) if level is not None else F.lit(False)
        k, used, open_weight = t.agg(F.sum(full.cast("long")), F.sum(F.when(full, F.col("_most")).otherwise(0.0)),
                                     F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if k == held or not open_weight:
            break
        held, level = k, (float(total) - used) / open_weight
    target = F.least(F.col("_most"), F.col("weight") * F.lit(float(level or 0.0)))
    return t.select("source", "source_size", "weight", target.alias("target"))


def _same(docs: DataFrame, text: str):
    """A hash of everything in a row: rows of one place in the shuffle are told apart by it."""
    return F.xxhash64(col(text).cast("string"), F.to_json(F.struct(F.lit(0).alias("_"), *[col(c) for c in docs.columns if c != text])))


def _decide(docs: DataFrame, text: str, source: str, key: str, weights: Sequence[float], max_repeats: int, seed: str,
            keep: Sequence[str]) -> DataFrame:
    """``keep``, ``_h`` and ``_th`` (place in the shuffle), size, source_size, target, repeats: one narrow row per document row."""
    rows = cut_lineage(docs.select(
        F.struct(F.lit(0).alias("_"), *[col(c) for c in keep]).alias("_row"), count_words(col(text)).alias("size"),
        col(source).cast("string").alias("source"), _place(col(key), seed).alias("_h"), _same(docs, text).alias("_th")), "mix-rows")
    n_rows, budget = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    targets = cut_lineage(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")),
                                         weights, max_repeats), "mix-targets")
    # running words of each source in shuffled order: hash ranges first, then inside a range
    n_buckets = max(1, -(-n_rows // ROWS_PER_BUCKET))
    x = rows.withColumn("_b", F.floor(F.conv(F.substring("_h", 1, 8), 16, 10).cast("double") / 2.0**32 * n_buckets))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("source").orderBy("_b").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    per = (x.groupBy("source", "_b").agg(F.sum("size").alias("_n"))
           .select(F.col("source").alias("_s1"), F.col("_b").alias("_b1"), before.alias("_before"))
           .join(targets.select(F.col("source").alias("_s2"), "source_size", "target"),
                 F.col("_s1").eqNullSafe(F.col("_s2"))))
    cum = F.sum("size").over(Window.partitionBy("source", "_b").orderBy("_h", "size", "_th").rowsBetween(
        Window.unboundedPreceding, 0))
    x = (x.withColumn("_in", cum).join(per, F.col("source").eqNullSafe(F.col("_s1")) & (F.col("_b") == F.col("_b1")))
         .withColumn("_cum", F.col("_in") + F.col("_before")))
    x = cut_lineage(x.select("_row", "_h", "_th", "size", "source_size", "target", "_cum",
                             F.coalesce("source", F.lit("\U0010ffff")).alias("_s")), "mix-queues")
    live = (F.col("size") > 0) & (F.col("target") > 0)
    # global order by finish time: time ranges (the last one open), totals before each range, then inside the cut range
    span = lambda f: F.least(F.floor(f * n_buckets), F.lit(4 * n_buckets))
    finish = lambda e: (F.lit(e) * F.col("source_size") + F.col("_cum")) / F.col("target")
    packets = (x.filter(live).select("_h", "_th", "_s", "size", F.explode(F.array(*[finish(e) for e in range(max_repeats)])).alias("f"))
               .withColumn("_t", span(F.col("f"))))
    spans = packets.groupBy("_t").agg(F.sum("size").alias("_n")).withColumn("_upto", F.sum("_n").over(Window.orderBy("_t")))
    edge, start = spans.agg(F.min(F.when(F.col("_upto") > budget, F.col("_t"))),
                            F.max(F.when(F.col("_upto") <= budget, F.col("_upto")))).first()
    if edge is None:
        inside = [F.lit(True)] * max_repeats
    else:
        line = F.sum("size").over(Window.orderBy("f", "_s", "_h", "_th").rowsBetween(Window.unboundedPreceding, 0))
        last = (packets.filter(F.col("_t") == edge).withColumn("_line", line + F.lit(start or 0))
                .filter(F.col("_line") <= budget).agg(F.max(F.struct("f", "_s", "_h", "_th"))).first()[0])
        if last is None:
            inside = [span(finish(e)) < edge for e in range(max_repeats)]
        else:
            inside = [F.struct(finish(e), F.col("_s"), F.col("_h"), F.col("_th")) <= F.struct(*[F.lit(v) for v in last])
                      for e in range(max_repeats)]
    repeats = F.when(live, sum((F.when(i, 1).otherwise(0) for i in inside), F.lit(0))).otherwise(0)
    return x.select(*[F.col("_row").getField(c).alias(c) for c in keep], "_h", "_th", "size", "source_size", "target",
                    repeats.alias("repeats"))


def _place(key, seed: str):
    return F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(key.cast("string"), F.lit(""))))


def mix_sources(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id",
                weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = "mix") -> DataFrame:
    """The key of every document row with its ``size``, its source's size and target, and the words ``taken``.

    ``taken`` is ``size`` times the number of the document's packets before
    the cut, 0 to ``max_repeats`` times.  The shuffle inside a source is the
    order of a hash of seed and key, equal places in the order of size and a
    hash of the row, so reruns agree.

    Null texts have size 0 and are never taken; a null source is a source of
    its own, after all others.  Repeated rows are separate packets (equal
    rows are interchangeable).  An empty table gives an empty result.  Extra
    columns are not read.
    """
    prepare(docs.sparkSession)
    own = docs.select(*[col(c) for c in dict.fromkeys([key, text, source])])
    d = _decide(own, text, source, key, weights, max_repeats, seed, [key])
    return d.select(col(key), "size", "source_size", "target", (F.col("size") * F.col("repeats")).cast("long").alias("taken"))


def take_mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id",
             weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = "mix") -> DataFrame:
    """The documents that the mix takes, with all their columns and ``repeats`` (how often, 1 to ``max_repeats``).

    A column of that name gives way.  The decisions are joined back by the
    document's place in the shuffle; the texts are shuffled once.
    """
    prepare(docs.sparkSession)
    own = [c for c in docs.columns if c != "repeats"]
    turn = F.row_number().over(Window.partitionBy("_h").orderBy("size", "_th"))
    kept = docs.select(*[col(c) for c in own])
    d = _decide(kept, text, source, key, weights, max_repeats, seed, []).withColumn("_turn", turn)
    d = d.filter(F.col("repeats") > 0).select("_h", "_turn", "repeats")
    rows = docs.select(F.struct(*[col(c) for c in own]).alias("_row"), count_words(col(text)).alias("size"),
                       _place(col(key), seed).alias("_h"), _same(kept, text).alias("_th")).withColumn("_turn", turn)
    return rows.join(d, ["_h", "_turn"]).select(*[F.col("_row").getField(c).alias(c) for c in own], "repeats")
