"""Folds, neighbours, exact medians, ranks and masked moments: invariants and brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.operators import stats as S
from panelspark.plans import prep as P


def test_ranked_in_equals_a_window(spark):
    rng = random.Random(2)
    rows = [(i, "hot" if rng.random() < 0.5 else rng.choice("abc"), rng.randrange(40)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, g string, v long").repartition(7)
    got = {r.id: r.rank for r in S.ranked_in(df, [F.desc("v"), F.col("id")], ["g"]).collect()}
    want, seen = {}, {}
    for i, g, v in sorted(rows, key=lambda r: (r[1], -r[2], r[0])):
        want[i] = seen.get(g, 0)
        seen[g] = want[i] + 1
    assert got == want
    assert S.ranked_in(df.limit(0), [F.col("id")]).count() == 0


def test_folds_are_balanced_and_stratified(spark):
    rng = random.Random(3)
    rows = [(e, i, int(e < 30 and i == 0)) for e in range(200) for i in range(rng.randint(1, 9))]   # 30 positives, one per entity
    df = spark.createDataFrame(rows, "e long, i long, y int").repartition(6)
    f = P.stratified_group_folds(df, "e", "y", 5).cache()
    assert f.count() == len(rows) and f.groupBy("e").agg(F.countDistinct("fold").alias("k")).filter("k > 1").count() == 0
    assert [r.p for r in f.groupBy("fold").agg(F.sum("y").alias("p")).collect()] == [6] * 5
    per = f.groupBy("fold").agg(F.countDistinct("e").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    assert [r.n for r in per] == [40] * 5 and max(r.rows for r in per) - min(r.rows for r in per) <= 9
    plain = P.group_folds(df, "e", 5).groupBy("fold").agg(F.countDistinct("e").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    assert [r.n for r in plain] == [40] * 5 and max(r.rows for r in plain) - min(r.rows for r in plain) <= 9
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:   # the folds do not depend on the cluster
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        again = P.stratified_group_folds(df, "e", "y", 5)
        assert {(r.e, r.fold) for r in again.collect()} == {(r.e, r.fold) for r in f.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_folds_with_a_null_entity_and_more_folds_than_entities(spark):
    df = spark.createDataFrame([(None, 1), (None, 0), (4, 1)], "e long, y int")
    got = P.stratified_group_folds(df, "e", "y", 5).collect()
    assert len(got) == 3 and len({r.fold for r in got if r.e is None}) == 1
    assert P.group_folds(df.limit(0), "e", 3).count() == 0
    assert (P.choose_folds(14_999), P.choose_folds(15_000)) == (5, 3)


def vectors(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim)) * 2
    return [(centres[i % 12] + rng.normal(size=dim)).tolist() for i in range(n)]


def frame(spark, v):
    return spark.createDataFrame([(str(i), x) for i, x in enumerate(v)], "id string, x array<double>").repartition(5)


def test_nearest_rows_recall_and_order(spark):
    v = vectors(1500, 20, 1)
    a = np.array(v)
    got = {r.id: r.neighbours for r in P.nearest_rows(frame(spark, v), "id", "x", 5).collect()}
    d = ((a[:, None] - a[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    truth = np.argsort(d, 1)[:, :5]
    hits = sum(len({n.id for n in got[str(i)]} & set(map(str, truth[i]))) for i in range(len(v)))
    assert hits / (5 * len(v)) >= 0.9
    assert all([n.d for n in x] == sorted(n.d for n in x) and i not in {n.id for n in x} for i, x in got.items())


def test_nearest_rows_in_small_blocks_with_copies(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_ROWS", 7)
    monkeypatch.setattr(P, "PROBES", 99)   # every cell: the result must be exact
    v = vectors(120, 4, 2) + [[9.0, 9.0, 9.0, 9.0]] * 60
    a = np.array(v)
    got = {r.id: r.neighbours for r in P.nearest_rows(frame(spark, v), "id", "x", 3).collect()}
    d = ((a[:, None] - a[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    for i in range(len(v)):
        assert np.allclose([n.d for n in got[str(i)]], np.sort(d[i])[:3])


def labelled(spark, minority, majority):
    from pyspark.ml.functions import array_to_vector
    rows = [(i, x, 1) for i, x in enumerate(minority)] + [(1000 + i, x, 0) for i, x in enumerate(majority)]
    return spark.createDataFrame(rows, "id long, x array<double>, y int").select("id", array_to_vector("x").alias("x"), "y")


def test_smote_balances_between_neighbours_on_any_number_of_partitions(spark):
    few = [[float(i), float(2 * i)] for i in range(20)]
    df = labelled(spark, few, vectors(75, 2, 5))
    runs, old = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("8", "200"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            runs.append({r.id: tuple(r.x) for r in P.smote(df, "x", "y", "id", k=3).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert runs[0] == runs[1] and len(runs[0]) == 75 - 20
    for key, (x, y) in runs[0].items():
        at = int(key.split("-")[0])
        assert abs(y - 2 * x) < 1e-9 and abs(x - at) <= 3   # on the way to one of the three nearest


def test_smote_of_few_or_no_rows(spark):
    df = labelled(spark, [[1.0, 2.0]], [[0.0, 0.0]] * 4)
    assert [tuple(r.x) for r in P.smote(df, "x", "y", "id").collect()] == [(1.0, 2.0)] * 3
    assert P.smote(df.filter("y = 0"), "x", "y", "id").count() == 0
    assert P.smote(df.limit(0), "x", "y", "id").count() == 0
    assert P.smote(df, "x", "y", "id", minority=0).count() == 0   # already more than the others


@pytest.mark.parametrize("keep", [10_000, 20])
def test_exact_medians(spark, keep):
    rng = random.Random(7)
    rows = [(rng.gauss(0, 1), float(rng.randrange(3)), 5.0, None if i % 3 else float(i), None,
             float("nan") if i % 2 else rng.lognormvariate(0, 3)) for i in range(4001)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double").repartition(6)
    cols = [[v for v in c if v is not None and v == v] for c in zip(*rows)]
    want = [float(np.median(c)) if c else None for c in cols]
    assert S.exact_medians(df, df.columns, keep) == want
    assert S.exact_medians(df.limit(4000), ["c"], keep) == [5.0]
    assert S.exact_medians(df.limit(0), ["a", "b"], keep) == [None, None]


def test_correlations_equal_pairwise_pearson(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(500, 4)) * [1, 1e-3, 1e6, 1] + [0, 5, 1e8, 0]
    base[:, 3] = base[:, 0] * 0.5 + base[:, 3]
    rows = [[None if rng.random() < 0.2 else float(x) for x in r] + [7.7, None] for r in base]
    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in "abcdke"])
    got = {(r.feature_a, r.feature_b): r.r for r in S.correlation_long(spark.createDataFrame(rows, schema).repartition(4), list("abcdke"), 6).collect()}
    assert len(got) == 36
    for i, a in enumerate("abcd"):
        for j, b in enumerate("abcd"):
            pair = np.array([(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None])
            assert abs(got[a, b] - np.corrcoef(pair.T)[0, 1]) < 2e-6
    assert {v for (a, b), v in got.items() if "k" in (a, b) or "e" in (a, b)} == {0.0}


def test_nearest_rows_are_exact_across_groups_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(P, "LEAF_ROWS", 16)
    monkeypatch.setattr(P, "PROBES", 2)
    monkeypatch.setattr(P, "CHUNK_BYTES", 5 * 32 * 8 * 30)   # five groups at a time
    rng = np.random.default_rng(4)
    a = np.vstack([np.array(vectors(700, 30, 3)), rng.integers(0, 2, (200, 30)) * 1.0, rng.normal(size=(3, 30)) * 1e4])   # ties and outliers, too
    a = np.unique(a, axis=0)
    got = {r.id: r.neighbours for r in P.nearest_rows(frame(spark, a.tolist()), "id", "x", 5).collect()}
    for i in range(len(a)):
        d = ((a[i] - a) ** 2).sum(1)
        want = sorted((x, str(j)) for j, x in enumerate(d) if j != i)[:5]
        assert [n.id for n in got[str(i)]] == [j for _, j in want] and np.allclose([n.d for n in got[str(i)]], [x for x, _ in want])


def test_rows_with_values_that_are_no_numbers_are_the_last_neighbours(spark):
    nan = float("nan")
    rows = [("a", [0.0, 0.0], True), ("b", [1.0, 0.0], True), ("c", [nan, 0.0], True), ("d", [0.0, nan], False)]
    df = spark.createDataFrame(rows, "id string, x array<double>, looks boolean")
    got = {r.id: [n.id for n in r.best] for r in P._nearest_different(df, 2, 42).collect()}
    assert got == {"a": ["b", "c"], "b": ["a", "c"], "c": ["a", "b"]}
