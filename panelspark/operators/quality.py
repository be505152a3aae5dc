"""Data quality, import and batch updates.

Rules are data: a list of ``Rule`` objects compiled into one array of
error structs per row, so validating costs one projection; no per-row
Python.  Updates are MERGE-style compositions (last update per key by
sequence via ``max_by``, then ``coalesce`` over a left join).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.bands import grade_letter, grade_point
from panelspark.functions.constants import (
    ACCOMMODATIONS, EMPLOYMENT_STATUSES, ENTRY_MODES, GENDERS, LEVELS, NOT_BLANK_COLUMNS, TRUE_STRINGS,
)
from panelspark.functions.numeric import rnd
from panelspark.operators.history import keep_first


@dataclass(frozen=True)
class Rule:
    """One field check.  kinds: not_blank, in_set, int, int_in, float_range, date, bool, positive_int."""
    field: str
    kind: str
    params: tuple = field(default_factory=tuple)


def _blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def _error(rule: Rule) -> tuple[Column, str]:
    """(violation predicate, message) for a rule over a string column."""
    c = F.col(rule.field)
    k, p = rule.kind, rule.params
    if k == "not_blank":
        return _blank(c), "must not be blank"
    if k == "in_set":
        return c.isNull() | ~F.trim(c).isin(list(p)), f"must be one of {', '.join(map(str, p))}"
    if k == "lower_in_set":
        return c.isNull() | ~F.lower(F.trim(c)).isin(list(p)), f"must be one of {', '.join(map(str, p))}"
    if k == "int":
        return c.isNull() | F.trim(c).try_cast("bigint").isNull(), "must be a valid integer"
    if k == "int_in":
        v = F.trim(c).try_cast("bigint")
        return c.isNull() | v.isNull() | ~v.isin(list(p)), f"must be one of {', '.join(map(str, p))}"
    if k == "positive_int":
        v = F.trim(c).try_cast("bigint")
        return c.isNull() | v.isNull() | (v <= 0), "must be a positive integer"
    if k == "float_range":
        lo, hi = p
        v = F.trim(c).try_cast("double")
        return c.isNull() | v.isNull() | (v < lo) | (v > hi), f"must be between {lo:g} and {hi:g}"
    if k == "date":
        return c.isNull() | F.try_to_date(F.trim(c), "yyyy-MM-dd").isNull(), "must be a valid date"
    if k == "bool":
        return c.isNull(), "must be a valid boolean"
    raise ValueError(f"unknown rule kind {k}")


def coerce_bool(c) -> Column:
    """true/1/yes/y (any case, trimmed) -> true; any other string -> false; null stays null."""
    col = F.col(c) if isinstance(c, str) else c
    return F.when(col.isNull(), F.lit(None).cast("boolean")).otherwise(F.lower(F.trim(col)).isin(list(TRUE_STRINGS)))


def validate_rows(df: DataFrame, rules: Sequence[Rule], line: str = "line_no",
                  row_offset: int = 2) -> tuple[DataFrame, DataFrame]:
    """All field errors of every row (I1): returns (valid rows, errors(row, field, message)).

    ``row`` = file line index + 2 (0-based index, plus the header).  Every
    rule is evaluated; a row is valid when its error array is empty.
    """
    structs = []
    for r in rules:
        bad, msg = _error(r)
        structs.append(F.when(bad, F.struct(F.lit(r.field).alias("field"), F.lit(msg).alias("message"))))
    errs = F.filter(F.array(*structs), lambda e: e.isNotNull())
    x = df.withColumn("_errors", errs)
    valid = x.filter(F.size("_errors") == 0).drop("_errors")
    errors = (x.filter(F.size("_errors") > 0)
              .select((F.col(line) + row_offset).alias("row"), F.posexplode("_errors").alias("_pos", "_e"))
              .select("row", "_pos", F.col("_e.field").alias("field"), F.col("_e.message").alias("message")))
    return valid, errors


def import_batch(df: DataFrame, rules: Sequence[Rule], key: Sequence[str], existing: DataFrame,
                 line: str = "line_no") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Validate -> keep first in file -> drop keys already stored.

    Returns (to_insert, skipped(key, reason, line), errors).  Blank checks
    run before the duplicate check because invalid rows never reach it.
    """
    valid, errors = validate_rows(df, rules, line)
    kept, dups = keep_first(valid, key, line)
    ex = existing.select(*key).distinct()
    to_insert = kept.join(ex, list(key), "left_anti")
    already = kept.join(ex, list(key), "left_semi")
    skipped = (already.select(*key, F.lit("exists").alias("reason"), line)
               .unionByName(dups.select(*key, F.lit("duplicate_in_file").alias("reason"), line)))
    return to_insert, skipped, errors


def validation_summary(df: DataFrame, errors: DataFrame, to_insert: DataFrame, skipped: DataFrame,
                       key: str) -> DataFrame:
    """total / valid / invalid / inserted / skipped keys in one row.

    The skipped-key list is sorted; at scale report it from ``skipped``
    itself (the list grows with the batch) - here it is kept as in the
    report contract.
    """
    total = df.agg(F.count(F.lit(1)).alias("total_rows"))
    invalid = errors.agg(F.countDistinct("row").alias("invalid_rows"))
    ins = to_insert.agg(F.count(F.lit(1)).alias("inserted"))
    sk = skipped.agg(F.count(F.lit(1)).alias("skipped"))
    return (total.crossJoin(invalid).crossJoin(ins).crossJoin(sk)
            .withColumn("valid_rows", F.col("total_rows") - F.col("invalid_rows"))
            .select("total_rows", "valid_rows", "invalid_rows", "inserted", "skipped"))


def parse_id_list(lines: DataFrame, text: str = "value", line: str = "line_no",
                  header_name: str = "student_id") -> tuple[DataFrame, DataFrame]:
    """First CSV cell of each line as an id.

    A first line equal to ``header_name`` (any case) is skipped; valid ids
    are positive integers; duplicates keep the first line.  Returns
    (ids(id, line), counts(valid, invalid, duplicate)).
    """
    cell = F.trim(F.split(F.col(text), ",").getItem(0))
    x = lines.select(line, cell.alias("_cell"))
    is_header = (F.col(line) == 0) & (F.lower(F.col("_cell")) == header_name.lower())
    x = x.filter(~is_header & (F.col("_cell") != ""))
    v = F.col("_cell").try_cast("bigint")
    ok = v.isNotNull() & (v > 0) & F.col("_cell").rlike(r"^\+?[0-9]+$")
    x = x.withColumn("id", F.when(ok, v))
    good = x.filter(F.col("id").isNotNull())
    kept, dups = keep_first(good.select("id", line), ["id"], line)
    counts = (x.agg(F.count_if(F.col("id").isNull()).alias("invalid"))
              .crossJoin(kept.agg(F.count(F.lit(1)).alias("valid")))
              .crossJoin(dups.agg(F.count(F.lit(1)).alias("duplicate"))))
    return kept, counts


def student_import_rules() -> list[Rule]:
    """The published contract of the student import."""
    return ([Rule(c, "not_blank") for c in NOT_BLANK_COLUMNS]
            + [Rule("level", "int_in", LEVELS), Rule("entry_mode", "in_set", ENTRY_MODES), Rule("entry_score", "float_range", (0.0, 400.0)),
               Rule("date_of_birth", "date"), Rule("gender", "in_set", GENDERS), Rule("accommodation", "in_set", ACCOMMODATIONS),
               Rule("employment_status", "in_set", EMPLOYMENT_STATUSES), Rule("has_scholarship", "bool")])


def _part(updates: DataFrame, problems: Sequence[tuple[Column, str]]) -> tuple[DataFrame, DataFrame]:
    found = F.filter(F.array(*[F.when(bad, F.lit(text)) for bad, text in problems]), lambda p: p.isNotNull())
    x = updates.withColumn("reason", F.array_join(found, "; "))
    return x.filter(F.col("reason") == "").drop("reason"), x.filter(F.col("reason") != "")


def split_score_updates(updates: DataFrame, ca: str = "ca_score", exam: str = "exam_score") -> tuple[DataFrame, DataFrame]:
    """(rows that I4 takes, rejected rows with a ``reason``): one bad update does not stop the others."""
    off = lambda c, high: F.coalesce(~F.col(c).between(0, high), F.lit(False))  # noqa: E731  NaN is above every number
    return _part(updates, [(off(ca, 30), f"{ca} must be between 0 and 30"), (off(exam, 70), f"{exam} must be between 0 and 70")])


def split_attendance_updates(updates: DataFrame, held: str = "sessions_held", attended: str = "sessions_attended",
                             enforce_le: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows that I5 takes, rejected rows with a ``reason``): counts must be there and not negative."""
    bad = lambda c: F.coalesce(F.col(c) < 0, F.lit(True))
    problems = [(bad(held), f"{held} must be 0 or more"), (bad(attended), f"{attended} must be 0 or more")]
    if enforce_le:
        problems.append((F.coalesce(F.col(attended) > F.col(held), F.lit(False)), f"{attended} exceeds {held}"))
    return _part(updates, problems)


def last_update(updates: DataFrame, key: Sequence[str], seq: str, cols: Sequence[str]) -> DataFrame:
    """Per key, each column's latest non-null value by sequence (``max_by`` skips nulls)."""
    aggs = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in cols]
    return updates.groupBy(*key).agg(*aggs)


def _in_range(c: Column, low: float, high: float, name: str) -> Column:
    """The value itself; a value outside the range raises when it is computed."""
    return F.when((c < low) | (c > high),
                  F.raise_error(F.lit(f"{name} must be between {low} and {high}")).cast("double")).otherwise(c)


def apply_score_updates(base: DataFrame, updates: DataFrame, key: Sequence[str], seq: str = "seq",
                        ca: str = "ca_score", exam: str = "exam_score") -> DataFrame:
    """Non-null CA/exam updates override; when both are present the row is graded (I4).

    Grade and points come from the raw sum, the stored total is that sum
    rounded to 2 digits; status = completed, carryover = (grade == 'F');
    otherwise the row keeps its status.  Updates outside 0-30 / 0-70 raise:
    the check is part of the value, so it cannot be pruned.
    """
    up = (updates.withColumns({ca: _in_range(F.col(ca), 0, 30, ca), exam: _in_range(F.col(exam), 0, 70, exam)}))
    up = last_update(up, key, seq, [ca, exam]).select(*key, F.col(ca).alias("_u_ca"), F.col(exam).alias("_u_exam"))
    x = base.join(up, list(key), "left")
    x = x.withColumns({ca: F.coalesce("_u_ca", F.col(ca)), exam: F.coalesce("_u_exam", F.col(exam))}).drop("_u_ca", "_u_exam")
    both = F.col(ca).isNotNull() & F.col(exam).isNotNull()
    raw = F.col(ca) + F.col(exam)
    return x.withColumns({
        "total_score": F.when(both, rnd(raw, 2)).otherwise(F.col("total_score")),
        "grade": F.when(both, grade_letter(raw)).otherwise(F.col("grade")),
        "grade_point": F.when(both, grade_point(raw)).otherwise(F.col("grade_point")),
        "status": F.when(both, F.lit("completed")).otherwise(F.col("status")),
        "is_carryover": F.when(both, grade_letter(raw) == "F").otherwise(F.col("is_carryover")),
    })


def apply_attendance_updates(base: DataFrame, updates: DataFrame, key: Sequence[str], held: str = "sessions_held",
                             attended: str = "sessions_attended", enforce_le: bool = False, seq: str = "seq") -> DataFrame:
    """Upsert by key: rate = attended / held, null unless held is positive.

    Of several updates of a key the last by ``seq`` counts, so one row per
    key stays.  Attended may exceed held (rate above 1); ``enforce_le`` makes
    that raise, inside the value so that it cannot be pruned.
    """
    pair = F.struct(held, attended)
    order = F.struct(seq, held, attended)
    up = updates.groupBy(*key).agg(F.max_by(pair, order).alias("_u"))
    value = F.col(f"_u.{attended}")
    if enforce_le:
        kind = updates.schema[attended].dataType
        value = F.when(value > F.col(f"_u.{held}"), F.raise_error(F.lit("attended exceeds held")).cast(kind)).otherwise(value)
    up = up.select(*key, F.col(f"_u.{held}").alias(held), value.alias(attended))
    rate = F.when(F.col(held) > 0, F.col(attended).cast("double") / F.col(held).cast("double"))
    up = up.withColumn("attendance_rate", rate)
    return base.join(up.select(*key), list(key), "left_anti").unionByName(up, allowMissingColumns=True)


def apply_status_updates(base: DataFrame, updates: DataFrame, key: Sequence[str], seq: str, cols: Sequence[str],
                         status: str = "status", resolved: str = "resolved_at", at: str = "updated_at",
                         closing: Sequence[str] = ("completed", "cancelled")) -> DataFrame:
    """Non-null fields override; every closing status renews ``resolved_at`` with its own time, nothing clears it."""
    closes = F.col(status).isin(list(closing))
    last = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(seq))).alias(f"_u_{c}") for c in cols]
    up = updates.groupBy(*key).agg(*last, F.max_by(F.col(at), F.when(closes, F.col(seq))).alias("_closed"))
    x = base.join(up, list(key), "left")
    x = x.withColumns({**{c: F.coalesce(f"_u_{c}", F.col(c)) for c in cols}, resolved: F.coalesce("_closed", F.col(resolved))})
    return x.drop("_closed", *[f"_u_{c}" for c in cols])


def insert_if_absent(existing: DataFrame, incoming: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(inserted rows, rejected rows) for a create on a unique key."""
    ex = existing.select(*key).distinct()
    return incoming.join(ex, list(key), "left_anti"), incoming.join(ex, list(key), "left_semi")


def delete_by_key(base: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    """Drop rows whose key is listed (I8)."""
    return base.join(keys.select(*key), list(key), "left_anti")


def patch_by_key(base: DataFrame, patch: DataFrame, key: Sequence[str], set_cols: Mapping[str, str] | None = None) -> DataFrame:
    """Partial update: only fields present (non-null) in the patch change (I8).

    ``set_cols`` names boolean columns of the patch that, when true, set the
    field even to null (explicit "set" map).
    """
    fields = [c for c in patch.columns if c not in key and c not in (set_cols or {}).values()]
    p = patch.select(*key, *[F.col(c).alias(f"_p_{c}") for c in fields],
                     *[F.col(v).alias(f"_s_{k}") for k, v in (set_cols or {}).items()])
    x = base.join(p, list(key), "left")
    upd = {}
    for c in fields:
        if set_cols and c in set_cols:
            upd[c] = F.when(F.coalesce(F.col(f"_s_{c}"), F.lit(False)), F.col(f"_p_{c}")).otherwise(
                F.coalesce(F.col(f"_p_{c}"), F.col(c)))
        else:
            upd[c] = F.coalesce(F.col(f"_p_{c}"), F.col(c))
    x = x.withColumns(upd)
    return x.drop(*[f"_p_{c}" for c in fields], *[f"_s_{k}" for k in (set_cols or {})])


def null_out(df: DataFrame, columns: Sequence[str], key: Sequence[str], seed: int = 42,
             lo: float = 0.04, hi: float = 0.08) -> DataFrame:
    """Null a seeded share of each column, the share drawn in [lo, hi] per column.

    Hash-based on (key, column, seed) so the result does not depend on
    partitioning or task retries (unlike ``rand``).
    """
    out = {}
    span = float(2 ** 31)
    for c in columns:
        rate = lo + (hi - lo) * (F.abs(F.xxhash64(F.lit(c), F.lit(seed))) % F.lit(2 ** 31)).cast("double") / span
        u = (F.abs(F.xxhash64(*[F.col(k) for k in key], F.lit(c), F.lit(seed + 1))) % F.lit(2 ** 31)).cast("double") / span
        out[c] = F.when(u >= rate, F.col(c))
    return df.withColumns(out)
