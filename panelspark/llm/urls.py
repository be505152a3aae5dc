"""URL filter: rules first, then a path-template tree per host.  DataFrame functions only.

The paths of a host are generalised segment by segment, to their last one,
into templates:

* branches with labelled pages whose share of blocked pages is statistically
  like that of their labelled siblings (two-proportion z-test) are merged,
  as ``*`` if the segment is a number or identifier, ``(any)`` if it has a
  small share among many siblings, else ``(alike)``; others keep their name,
  so do those without a labelled sibling to compare with;
* branches without labels are merged into those if their own shape (shares
  of pages that end here and that go on with a variable segment, mean depth)
  is statistically like the shape of the merged labelled branches, numbers
  and identifiers in any case; what is left is merged without labels.

The labelled pages are those that a rule decides.  A template is rejected if
its share of blocked among labelled pages, smoothed towards the overall
share, reaches ``PURITY``; a template without labels keeps the prior.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.frames import col, cut_lineage, prepare

# The rules of the registered query.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
FANOUT, SHARE = 10, 0.2   # a value among so many siblings and with at most this share is variable
Z = 1.96                  # branches within so many standard errors are alike
PRIOR_WEIGHT = 4.0
PURITY = 0.8
_VARIABLE = r"^[0-9]+([._-][0-9A-Za-z]+)?$|^[0-9a-fA-F-]{16,}$"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, null without one."""
    rule = verdict = None
    for kind, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, _, tail = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + tail)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return (rule if rules else F.lit(None).cast("string")), (verdict if rules else F.lit(None).cast("string"))


def _like(hits: Column, n: Column, other_hits: Column, other_n: Column) -> Column:
    """Two-proportion z-test; null if either side is empty."""
    p = (hits + other_hits) / (n + other_n)
    return F.when((n > 0) & (other_n > 0), F.abs(hits / n - other_hits / other_n) <= Z * F.sqrt(F.greatest(p * (1 - p), F.lit(0.0)) * (1 / n + 1 / other_n)) + 1e-9)


def templates(paths: DataFrame) -> DataFrame:
    """Adds ``template`` to (host, segs, n, bad, known): one row per distinct host and path segments.

    Goes down a segment at a time until every path has ended or is alone below its node.
    """
    x = paths.withColumn("template", F.lit(""))
    done, level = None, 0
    shape = ["n", "ends", "goes", "deep", "deep2"]
    c = F.col
    while True:
        size = F.size("segs")
        x = x.withColumns({"seg": F.coalesce(F.get("segs", F.lit(level)), F.lit("")), "ends": F.when(size == level + 1, c("n")).otherwise(0),
                           "goes": F.when(F.coalesce(F.get("segs", F.lit(level + 1)), F.lit("")).rlike(_VARIABLE), c("n")).otherwise(0),
                           "deep": size * c("n"), "deep2": size * size * c("n")})
        # one row per branch; paths that end here have the empty branch
        branch = x.groupBy("host", "template", "seg").agg(F.count(F.lit(1)).alias("rows"), *(F.sum(k).alias(k) for k in ("bad", "known", *shape)))
        node = branch.groupBy("host", "template").agg(F.sum("n").alias("all_n"), F.sum("bad").alias("all_bad"), F.sum("known").alias("all_known"),
                                                      F.sum("rows").alias("all_rows"), F.count(F.lit(1)).alias("fan"))
        b = branch.join(node, ["host", "template"])
        kind = (F.when(c("seg").rlike(_VARIABLE), "/*").when((c("fan") >= FANOUT) & (c("n") <= c("all_n") * SHARE), "/(any)").otherwise("/(alike)"))
        b = b.withColumns({"kind": kind, "alike": (c("seg") != "") & F.coalesce(
            _like(c("bad"), c("known"), c("all_bad") - c("bad"), c("all_known") - c("known")), F.lit(False))})
        group = (b.filter("alike").groupBy("host", "template")
                 .agg(*(F.sum(k).alias(f"g_{k}") for k in shape), F.collect_set("kind").alias("kinds")))   # three kinds at most
        b = b.join(group, ["host", "template"], "left")
        both = c("n") + c("g_n")
        spread = (c("deep2") + c("g_deep2")) / both - ((c("deep") + c("g_deep")) / both) * ((c("deep") + c("g_deep")) / both)
        shaped = F.coalesce(_like(c("ends"), c("n"), c("g_ends"), c("g_n")) & _like(c("goes"), c("n"), c("g_goes"), c("g_n"))
                            & (F.abs(c("deep") / c("n") - c("g_deep") / c("g_n")) <= Z * F.sqrt(F.greatest(spread, F.lit(0.0)) * (1 / c("n") + 1 / c("g_n"))) + 1e-9), F.lit(False))
        joins = F.when(F.array_contains("kinds", c("kind")), c("kind")).otherwise(F.element_at(F.array_sort("kinds"), 1))
        name = (F.when(c("seg") == "", F.lit("/"))
                .when(c("known") > 0, F.when(c("alike"), c("kind")).otherwise(F.concat(F.lit("/"), c("seg"))))
                .when(c("kind") == "/*", c("kind")).when(shaped, joins).otherwise(F.lit("/(unlabelled)")))
        # a path alone below its node has no siblings from here on
        rest = F.transform(F.slice("segs", level + 1, F.greatest(size, F.lit(1))), lambda s: F.when((c("known") == 0) & s.rlike(_VARIABLE), F.lit("/*"))
                           .when(c("known") == 0, F.lit("/(unlabelled)")).otherwise(F.concat(F.lit("/"), s)))
        alone = c("all_rows") == 1
        x = cut_lineage(x.join(b.select("host", "template", "seg", "all_rows", name.alias("step")), ["host", "template", "seg"])
                        .withColumns({"template": F.when(alone, F.concat(c("template"), F.array_join(rest, ""), F.lit("/"))).otherwise(F.concat("template", "step")),
                                      "open": ~alone & (c("seg") != "")}).select("host", "segs", "n", "bad", "known", "template", "open"), "url-templates")
        closed = x.filter("not open").drop("open")
        done = closed if done is None else done.unionByName(closed)
        x = x.filter("open").drop("open")
        level += 1
        if not x.limit(1).count():
            return done


def filter_urls(pages: DataFrame, url: str = "url", key: str = "page_id",
                rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """Per page row: its key, ``host``, ``path``, the deciding ``rule`` (or null) and the ``verdict``.

    ``template``, ``purity`` and ``decided_by`` follow.  A null url, or one
    without ``://``, has an empty host and path and is judged by the template
    of those.  Repeated rows each get a row and count each; urls are compared
    as they stand (no decoding).  Without labelled pages all are allowed.
    """
    prepare(pages.sparkSession)
    host, path = host_and_path(col(url))
    x = pages.select(col(key).alias("__key"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    segs = F.filter(F.split("path", "/"), lambda s: s != "")
    x = x.select("__key", "host", "path", rule.alias("rule"), verdict.alias("by_rule"), segs.alias("segs"))
    paths = x.groupBy("host", "segs").agg(F.count(F.lit(1)).alias("n"), F.sum((F.coalesce(F.col("by_rule"), F.lit("")) == "block").cast("long")).alias("bad"),
                                          F.count("by_rule").alias("known"))
    t = templates(cut_lineage(paths, "url-paths"))
    prior = t.agg(((F.sum("bad") + 1) / (F.sum("known") + 2)).alias("prior"))
    stats = (t.groupBy("host", "template").agg(F.sum("bad").alias("bad"), F.sum("known").alias("known"))
             .crossJoin(F.broadcast(prior))   # one row
             .select("host", "template", ((F.col("bad") + PRIOR_WEIGHT * F.col("prior")) / (F.col("known") + PRIOR_WEIGHT)).alias("purity"), "known"))
    judged = t.select("host", "segs", "template").join(stats, ["host", "template"])
    method = F.when((F.col("known") > 0) & (F.col("purity") >= PURITY), F.lit("block")).otherwise(F.lit("allow"))
    return (x.join(judged, ["host", "segs"], "left")
            .select(F.col("__key").alias(key), "host", "path", "rule", F.coalesce("by_rule", method).alias("verdict"),
                    "template", "purity", F.when(F.col("by_rule").isNotNull(), "rule").otherwise("template").alias("decided_by")))
