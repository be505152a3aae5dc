"""Distributed statistics building blocks.

* ``safe_corr`` - pairwise-complete Pearson that returns 0 where undefined
  (``corr`` raises DIVIDE_BY_ZERO on a constant column under ANSI).
* ``ordered_cumsum`` - running sums along a global order *without* a
  single-partition window: rows are cut into balanced buckets by approximate
  quantiles, each bucket runs its own window, and a tiny table of bucket
  totals supplies the offsets.  Used by ROC / PR curves and exact quantiles.
* ``exact_quantiles`` - linear-interpolated quantiles (numpy's default)
  computed from cumulative counts, so no group ever holds all values.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from panelspark.functions.numeric import rnd


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_corr(a, b) -> Column:
    """Pearson r over rows where both are non-null; 0.0 when undefined."""
    a, b = _col(a), _col(b)
    both = a.isNotNull() & b.isNotNull()
    am, bm = F.when(both, a), F.when(both, b)
    r = F.try_divide(F.covar_pop(am, bm), F.stddev_pop(am) * F.stddev_pop(bm))
    return F.coalesce(F.when(~F.isnan(r), r), F.lit(0.0))


def correlation_long(df: DataFrame, columns: Sequence[str], digits: int = 3) -> DataFrame:
    """Full correlation matrix as ``(feature_a, feature_b, r)``, pairwise-complete, 0 where undefined.

    The columns are written once and read twice: for their means (one
    aggregate row), then for the moments of the centred columns.  A task adds up masked k x k moment
    matrices batch by batch and emits one row per column pair, so the shuffle
    holds tasks x pairs rows whatever the number of input rows.  NaN counts
    as missing.
    """
    cols = list(columns)
    k = len(cols)
    x = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"c{i}") for i, c in enumerate(cols)])
    from panelspark.session import cut_lineage
    x = cut_lineage(x, "correlated")
    means = x.agg(*[F.avg(f"c{i}").alias(f"c{i}") for i in range(k)]).first()
    centre = [m if m is not None else 0.0 for m in means]

    def moments(batches):
        import numpy as np
        import pyarrow as pa
        n, s, q, p = (np.zeros((k, k)) for _ in range(4))
        for b in batches:
            v = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(k)], 1).astype(float) - centre
            there = (~np.isnan(v)).astype(float)
            v = np.where(there > 0, v, 0.0)
            n += there.T @ there
            s += v.T @ there          # [a, b]: sum of a where b is there, too
            q += (v * v).T @ there
            p += v.T @ v
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays([pa.array(z) for z in (i, j, n[i, j], s[i, j], s[j, i], q[i, j], q[j, i], p[i, j])],
                                         names=["i", "j", "n", "sa", "sb", "qa", "qb", "p"])

    parts = x.mapInArrow(moments, "i long, j long, n double, sa double, sb double, qa double, qb double, p double")
    g = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "qa", "qb", "p")])
    cov = F.try_divide("p", "n") - F.try_divide("sa", "n") * F.try_divide("sb", "n")
    var = lambda z, y: F.try_divide(z, "n") - F.try_divide(y, "n") * F.try_divide(y, "n")
    # a variance that is rounding noise against the mean square belongs to a constant column
    real = lambda z, y: var(z, y) > F.lit(1e-14) * F.try_divide(z, "n")
    r = F.when(real("qa", "sa") & real("qb", "sb"), cov / F.sqrt(var("qa", "sa") * var("qb", "sb")))
    g = g.select("i", "j", rnd(F.coalesce(r, F.lit(0.0)), digits).alias("r"))
    # the pairs, k (k + 1) / 2 of them, whether the input has rows or not; each off-diagonal one both ways
    every = (df.sparkSession.range(k * k).select((F.col("id") / k).cast("long").alias("i"), (F.col("id") % k).alias("j"))
             .filter(F.col("i") <= F.col("j")))
    full = every.join(F.broadcast(g), ["i", "j"], "left").select("i", "j", F.coalesce("r", F.lit(0.0)).alias("r"))
    cell = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    both = F.when(F.col("i") == F.col("j"), F.array(cell("i", "j"))).otherwise(F.array(cell("i", "j"), cell("j", "i")))
    names = F.array(*[F.lit(c) for c in cols])
    return full.select(F.explode(both).alias("c"), "r").select(
        F.element_at(names, (F.col("c.a") + 1).cast("int")).alias("feature_a"),
        F.element_at(names, (F.col("c.b") + 1).cast("int")).alias("feature_b"), "r")


def ranked_in(df: DataFrame, order: Sequence[Column], by: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """0-based place of each row along ``order`` inside its group of ``by``, without a window over a whole group.

    Rows are sorted into key ranges; a row's place is its place in its range
    plus what the earlier ranges hold of its group.  Only the first group of
    a range can have begun before it, so that table has a row per range.
    ``order`` must be total for the places to be defined; the group columns
    must not be null.
    """
    from panelspark.session import cut_lineage
    by = list(by)
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    x = cut_lineage(df.repartitionByRange(n, *by, *order).withColumn("_range", F.spark_partition_id()), "ranked")
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = (x.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.sum("_n").over(earlier))
              .filter(F.col("_before") > 0).drop("_n"))
    x = x.withColumn("_in", F.row_number().over(Window.partitionBy("_range", *by).orderBy(*order)) - 1)
    return (x.join(F.broadcast(before), [*by, "_range"], "left")
            .select(*df.columns, (F.col("_in") + F.coalesce("_before", F.lit(0))).cast("long").alias(out)))


IN_BRACKET = 10_000


def exact_medians(df: DataFrame, columns: Sequence[str], keep: int = IN_BRACKET) -> list[float | None]:
    """The interpolated median of each column (nulls and NaN left out; None without values).

    Every pass is one aggregate row over all columns.  A column's open
    bracket is cut at two of its values, taken from approximate quantiles on
    both sides of the median; counts of what lies below, at and between them
    say which piece holds the middle ranks.  A cut value that is a middle
    rank is known at once, and neither lies in the next bracket, so columns
    of few distinct values end as well.  Once a bracket holds at most
    ``keep`` values these are brought over and sorted.
    """
    cols = list(columns)
    x = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"c{i}") for i, c in enumerate(cols)])
    near, n = 0.002, {}
    known: dict[int, dict[int, float]] = {i: {} for i in range(len(cols))}   # value of each middle rank
    bracket: dict[int, tuple] = {i: (None, None, 0, 0) for i in known}       # bounds (outside), values inside, values before

    def inside(i: int) -> Column:
        low, high = bracket[i][:2]
        c = F.col(f"c{i}")
        return c.isNotNull() & (F.lit(True) if low is None else c > F.lit(low)) & (F.lit(True) if high is None else c < F.lit(high))

    def ranks(i: int) -> list[int]:
        return [r for r in ((n[i] - 1) // 2, n[i] // 2) if r not in known[i]]

    def cuts(i: int) -> Column:
        _, _, held, before = bracket[i]
        share = [(r - before + 0.5) / held for r in ranks(i)] if n else [0.5]
        return F.percentile_approx(F.when(inside(i), F.col(f"c{i}")), [max(0.0, min(share) - near), min(1.0, max(share) + near)], 1000)

    while bracket:
        todo = list(bracket)
        got = x.agg(*[cuts(i) for i in todo], *([] if n else [F.count(f"c{i}") for i in todo])).first()
        tried = dict(zip(todo, got))
        if not n:
            n.update(zip(todo, got[len(todo):]))
            bracket = {i: (None, None, n[i], 0) for i in todo if n[i]}
            todo = list(bracket)
        if not todo:
            break
        sizes = iter(x.agg(*[F.count_if(inside(i) & how) for i in todo for c, (a, b) in [(F.col(f"c{i}"), tried[i])]
                             for how in (c < F.lit(a), c <= F.lit(a), c < F.lit(b), c <= F.lit(b))]).first())
        for i in todo:
            (low, high, held, before), (a, b) = bracket[i], tried[i]
            below_a, to_a, below_b, to_b = (next(sizes) for _ in range(4))
            pieces = [(0, below_a, low, a), (to_a, max(to_a, below_b), a, b), (to_b, held, b, high)]
            for r in ranks(i):
                at = r - before
                if below_a <= at < to_a or below_b <= at < to_b:
                    known[i][r] = a if at < to_a else b
            rest = ranks(i)
            if not rest:
                del bracket[i]
                continue
            start, end, lo, hi = next(p for p in pieces if p[0] <= rest[0] - before < p[1])
            bracket[i] = (lo, hi, end - start, before + start)
        ready = [i for i, v in bracket.items() if v[2] <= keep]
        if ready:
            got = x.agg(*[F.sort_array(F.collect_list(F.when(inside(i), F.col(f"c{i}")))) for i in ready]).first()
            for i, values in zip(ready, got):
                known[i].update({r: values[r - bracket[i][3]] for r in ranks(i)})
                del bracket[i]
    out: list[float | None] = []
    for i in range(len(cols)):
        if not n.get(i):
            out.append(None)
            continue
        a, b = known[i][(n[i] - 1) // 2], known[i][n[i] // 2]
        out.append(a + (b - a) * 0.5 if (n[i] - 1) % 2 else a)
    return out


def medians_of_frames(df: DataFrame, columns: Sequence[str], by: Sequence[str], frames: Mapping[str, Callable[[Row], bool]],
                      keep: int = IN_BRACKET) -> dict[str, list[float | None]]:
    """``exact_medians`` of several frames at once, each a union of groups of ``by``: frame -> median per column.

    ``by`` must have few groups.  A column has one bracket for all frames: it
    is cut at two values, counts per group say what each frame has below, at
    and between them, and the next bracket spans the pieces with the frames'
    middle ranks.  Where a bracket stops getting narrower (frames whose
    medians lie apart) the frames' medians are looked for one by one.
    """
    cols, by = list(columns), list(by)
    x = df.select(*by, *[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"_c{i}") for i, c in enumerate(cols)])
    near = 0.004
    bracket: dict[int, tuple] = {i: (None, None) for i in range(len(cols))}
    share = {i: (0.5, 0.5) for i in bracket}
    size: dict[int, float] = {i: math.inf for i in bracket}
    known: dict[tuple[str, int], dict[int, float]] = {(f, i): {} for f in frames for i in bracket}
    n: dict[tuple[str, int], int] = {}
    before: dict[tuple[str, int], int] = {}    # values up to the bracket
    apart: list[int] = []

    def inside(i: int) -> Column:
        low, high = bracket[i]
        c = F.col(f"_c{i}")
        return c.isNotNull() & (F.lit(True) if low is None else c > F.lit(low)) & (F.lit(True) if high is None else c < F.lit(high))

    def ranks(f: str, i: int) -> list[int]:
        return [r for r in ((n[f, i] - 1) // 2, n[f, i] // 2) if r not in known[f, i]] if n[f, i] else []

    def per_group(aggs: Sequence[Column]) -> list[tuple[Row, list]]:
        rows = x.groupBy(*by).agg(*aggs).collect() if aggs else []   # few groups
        return [(r, list(r)[len(by):]) for r in rows]

    while bracket:
        todo = list(bracket)
        got = x.agg(*[F.percentile_approx(F.when(inside(i), F.col(f"_c{i}")), [max(0.0, share[i][0] - near), min(1.0, share[i][1] + near)], 1000)
                      for i in todo]).first()
        tried = {i: tuple(v) if v else (None, None) for i, v in zip(todo, got)}
        for i in [i for i in todo if tried[i][0] is None]:   # nothing in it: no frame has values
            n.update({(f, i): 0 for f in frames})
            del bracket[i]
        todo = list(bracket)
        counted = per_group([F.count_if(inside(i) & how) for i in todo for c, (a, b) in [(F.col(f"_c{i}"), tried[i])]
                             for how in (c < F.lit(a), c <= F.lit(a), c < F.lit(b), c <= F.lit(b), F.lit(True))])
        for at, i in enumerate(todo):
            (low, high), (a, b) = bracket[i], tried[i]
            spans, held, parts = [], [], {}
            for f, has in frames.items():
                below_a, to_a, below_b, to_b, every = (sum(v[5 * at + j] for r, v in counted if has(r)) for j in range(5))
                if (f, i) not in n:
                    n[f, i], before[f, i] = every, 0
                for r in ranks(f, i):
                    p = r - before[f, i]
                    if below_a <= p < to_a or below_b <= p < to_b:
                        known[f, i][r] = a if p < to_a else b
                pieces = [(0, below_a, low, a), (to_a, max(to_a, below_b), a, b), (to_b, every, b, high)]
                for r in ranks(f, i):
                    spans.append((f, r, next(p for p in pieces if p[0] <= r - before[f, i] < p[1])))
                parts[f] = (below_a, to_a, below_b, to_b, every)
            if not spans:
                del bracket[i]
                continue
            lows, highs = [p[2] for *_, p in spans], [p[3] for *_, p in spans]
            lo, hi = None if None in lows else min(lows), None if None in highs else max(highs)
            at_lo = {f: 0 if lo is None or lo == low else v[1] if lo == a else v[3] for f, v in parts.items()}
            at_hi = {f: v[4] if hi is None or hi == high else v[2] if hi == b else v[0] for f, v in parts.items()}
            before.update({(f, i): before[f, i] + at_lo[f] for f in frames})
            held = {f: at_hi[f] - at_lo[f] for f in frames}
            places = [(r - before[f, i] + 0.5) / held[f] for f, r, _ in spans]
            share[i], bracket[i] = (min(places), max(places)), (lo, hi)
            if max(held.values()) > keep and max(held.values()) > size[i] / 2:
                apart.append(i)
                del bracket[i]
            else:
                size[i] = max(held.values())
        ready = [i for i in bracket if size[i] <= keep]
        lists = per_group([F.collect_list(F.when(inside(i), F.col(f"_c{i}"))) for i in ready])
        for at, i in enumerate(ready):
            for f, has in frames.items():
                if rest := ranks(f, i):
                    values = sorted(v for r, got in lists if has(r) for v in got[at])
                    known[f, i].update({r: values[r - before[f, i]] for r in rest})
            del bracket[i]
    out: dict[str, list[float | None]] = {}
    groups = x.select(*by).distinct().collect() if apart else []
    for f, has in frames.items():
        found: list[float | None] = []
        for i in range(len(cols)):
            if not n[f, i] or i in apart:
                found.append(None)
                continue
            a, b = known[f, i][(n[f, i] - 1) // 2], known[f, i][n[f, i] // 2]
            found.append(a + (b - a) * 0.5 if (n[f, i] - 1) % 2 else a)
        if apart:
            own = F.lit(False)
            for r in groups:
                if has(r):
                    same = F.lit(True)
                    for c in by:
                        same = same & F.col(c).eqNullSafe(F.lit(r[c]))
                    own = own | same
            for i, m in zip(apart, exact_medians(x.filter(own), [f"_c{i}" for i in apart], keep)):
                found[i] = m
        out[f] = found
    return out


def ordered_cumsum(df: DataFrame, order_col: str, sum_cols: Sequence[str], partition_cols: Sequence[str] = (),
                   descending: bool = False, buckets: int | None = None, suffix: str = "_cum",
                   materialize: bool = True) -> DataFrame:
    """Inclusive running sums of ``sum_cols`` along ``order_col`` (one row per distinct order value).

    Scales past a single-partition window: bucket edges come from
    ``percentile_approx`` per partition group (a bounded table of
    ``groups x buckets`` values), each bucket is windowed independently, and
    bucket offsets come from a prefix over the bucket totals.
    """
    spark = df.sparkSession
    if buckets is None:
        buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    parts = list(partition_cols)
    if materialize:
        # the input is read by four branches (edges, bucket totals, windows, join); writing the
        # (already aggregated) table once to the shared folder keeps its source from running 4x
        from panelspark.session import cut_lineage
        df = cut_lineage(df, "cumsum-input")
    ordv = -F.col(order_col) if descending else F.col(order_col)
    x = df.withColumn("_ord", ordv)
    if buckets > 1:
        qs = [i / buckets for i in range(1, buckets)]
        edges_agg = F.percentile_approx("_ord", qs, 10000).alias("_edges")
        edges = x.groupBy(*parts).agg(edges_agg) if parts else x.agg(edges_agg)
        x = x.crossJoin(F.broadcast(edges)) if not parts else x.join(edges, parts)
        x = x.withColumn("_b", F.size(F.filter("_edges", lambda e: e < F.col("_ord")))).drop("_edges")
    else:
        x = x.withColumn("_b", F.lit(0))
    tot = x.groupBy(*parts, "_b").agg(*[F.sum(c).alias(f"_t_{c}") for c in sum_cols])
    wb = Window.partitionBy(*parts).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.select(*parts, "_b", *[F.coalesce(F.sum(f"_t_{c}").over(wb), F.lit(0)).alias(f"_o_{c}")
                                    for c in sum_cols])
    w = Window.partitionBy(*parts, "_b").orderBy("_ord").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({f"_w_{c}": F.sum(c).over(w) for c in sum_cols})
    tot = F.broadcast(tot) if not parts else tot
    x = x.join(tot, [*parts, "_b"])
    return x.select(*[c for c in df.columns],
                    *[(F.col(f"_w_{c}") + F.col(f"_o_{c}")).alias(f"{c}{suffix}") for c in sum_cols])


def exact_quantiles(df: DataFrame, value_col: str, qs: Sequence[float], partition_cols: Sequence[str] = (),
                    names: Sequence[str] | None = None, buckets: int | None = None) -> DataFrame:
    """Quantiles with linear interpolation between order statistics (numpy default).

    Nulls are ignored.  Values are first counted per distinct value
    (partial aggregation), then ranked by ``ordered_cumsum``; each quantile
    is read off as the first value whose cumulative count passes its rank.
    """
    parts = list(partition_cols)
    names = list(names) if names else [f"q{int(round(q * 100))}" for q in qs]
    counts = (df.filter(F.col(value_col).isNotNull())
              .groupBy(*parts, F.col(value_col).alias("_v")).agg(F.count(F.lit(1)).alias("_n")))
    cum = ordered_cumsum(counts, "_v", ["_n"], parts, buckets=buckets)
    totals = counts.groupBy(*parts).agg(F.sum("_n").alias("_total"))
    cum = cum.crossJoin(F.broadcast(totals)) if not parts else cum.join(totals, parts)
    aggs = []
    for q, name in zip(qs, names):
        pos = (F.col("_total") - 1) * F.lit(float(q))
        klo = F.floor(pos)
        khi = F.least(klo + 1, F.col("_total") - 1)
        aggs += [F.min(F.when(F.col("_n_cum") > klo, F.col("_v"))).alias(f"_lo_{name}"),
                 F.min(F.when(F.col("_n_cum") > khi, F.col("_v"))).alias(f"_hi_{name}"),
                 F.first(pos - klo).alias(f"_fr_{name}")]
    res = cum.groupBy(*parts).agg(*aggs) if parts else cum.agg(*aggs)
    return res.select(*parts, *[(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_fr_{n}"))
                                .alias(n) for n in names])


def modal_value(df: DataFrame, keys: Sequence[str], value_col: str, out: str = "mode") -> DataFrame:
    """Most frequent non-null value per key; smallest value on ties.

    Counts per (key, value) with map-side combine, then ``min_by`` over
    (-count, value): no group ever materialises its values.
    """
    c = (df.filter(F.col(value_col).isNotNull())
         .groupBy(*keys, value_col).agg(F.count(F.lit(1)).alias("_n")))
    pick = F.min_by(F.col(value_col), F.struct(-F.col("_n"), F.col(value_col))).alias(out)
    return c.groupBy(*keys).agg(pick) if keys else c.agg(pick)
