"""Row-level expressions and schema guards."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.functions.bands import clip
from panelspark.functions.constants import FORBIDDEN_COLUMNS, PROTECTED_ATTRIBUTES, RMSE_FALLBACK


class LeakageError(ValueError):
    """A feature table carries a column describing the outcome being predicted."""


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_ratio(num, den) -> Column:
    """num / den, null when the denominator is zero or null.

    Plain ``/`` raises under ANSI mode; ``try_divide`` yields null.
    """
    d = _col(den)
    return F.when(d != 0, F.try_divide(_col(num), d))


def interactions(df: DataFrame, specs: Mapping[str, tuple[str, str, str]]) -> DataFrame:
    """Add product / ratio features (B7): ``{name: ("mul"|"div", a, b)}``."""
    cols = {}
    for name, (op, a, b) in specs.items():
        cols[name] = F.col(a) * F.col(b) if op == "mul" else safe_ratio(a, b)
    return df.withColumns(cols)


def escape_like(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def search_rows(df: DataFrame, equals: Mapping[str, object] | None = None,
                text: str | None = None, text_columns: Iterable[str] = ()) -> DataFrame:
    """AND of optional equality filters + case-insensitive contains over columns.

    Equality predicates reach the Parquet scan as pushed filters; the
    pattern is escaped so ``%``/``_`` in user text match literally.
    """
    cond = F.lit(True)
    for c, v in (equals or {}).items():
        if v is not None:
            cond = cond & (F.col(c) == F.lit(v))
    if text:
        pattern = f"%{escape_like(text)}%"
        any_col = None
        for c in text_columns:
            hit = F.col(c).ilike(pattern)
            any_col = hit if any_col is None else (any_col | hit)
        if any_col is not None:
            cond = cond & any_col
    return df.filter(cond)


_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
            T.DecimalType, T.BooleanType)


def column_types(df: DataFrame, columns: Iterable[str] | None = None) -> tuple[list[str], list[str]]:
    """Split columns into (numeric, categorical) from the schema (B10); metadata only."""
    wanted = list(columns) if columns is not None else df.columns
    fields = {f.name: f.dataType for f in df.schema.fields}
    categorical = [c for c in wanted if not isinstance(fields[c], _NUMERIC)]
    numeric = [c for c in wanted if c not in categorical]
    return numeric, categorical


_RENAME = None


def _rename_map(df: DataFrame) -> dict[str, set[str]]:
    """alias -> source names for pure renames (``x AS y``) anywhere in the analysed plan.

    Derived expressions (lags, windows, arithmetic) are not followed: a
    prior-period value computed from an outcome column is a legitimate
    feature; a bare rename of the outcome column is a leak.  The plan is
    fetched as one tree string (a single JVM call) and scanned for
    ``name#id AS alias#id`` entries.
    """
    import re
    global _RENAME
    if _RENAME is None:
        _RENAME = re.compile(r"(?<![\w.(])([A-Za-z_][A-Za-z0-9_]*)#\d+L? AS ([A-Za-z_][A-Za-z0-9_]*)#\d+")
    try:
        text = df._jdf.queryExecution().analyzed().treeString()
    except Exception:  # pragma: no cover - lineage is best effort
        return {}
    alias_refs: dict[str, set[str]] = {}
    for src, alias in _RENAME.findall(text):
        if src != alias:
            alias_refs.setdefault(alias, set()).add(src)
    return alias_refs


def _lineage_sources(alias_refs: dict[str, set[str]], column: str) -> set[str]:
    seen, frontier = set(), {column}
    while frontier:
        name = frontier.pop()
        for ref in alias_refs.get(name, ()):
            if ref not in seen:
                seen.add(ref)
                frontier.add(ref)
    return seen


def assert_no_leakage(df: DataFrame, task: str, feature_columns: Iterable[str] | None = None,
                      check_lineage: bool = True) -> None:
    """Raise LeakageError if a forbidden outcome column feeds the features.

    Checks names and, as an extension, the analysed-plan lineage so a
    renamed outcome column (``exam_score AS x``) is caught too.
    """
    outcomes = FORBIDDEN_COLUMNS.get(task)
    if outcomes is None:
        raise ValueError(f"no outcome columns are declared for task '{task}' (declared: {', '.join(sorted(FORBIDDEN_COLUMNS))})")
    cols = df.columns if feature_columns is None else list(feature_columns)
    named = [c for c in cols if c in outcomes]
    if named:
        raise LeakageError(f"the features of task '{task}' contain its outcome: {', '.join(sorted(named))}")
    if check_lineage:
        renames = _rename_map(df)
        for c in cols:
            src = _lineage_sources(renames, c)
            hit = sorted(outcomes.intersection(src) - {c})
            if hit:
                raise LeakageError(f"feature '{c}' of task '{task}' is a renamed outcome: {', '.join(hit)}")


def drop_protected(df: DataFrame, protected: Iterable[str] = PROTECTED_ATTRIBUTES,
                   allow: bool = False) -> DataFrame:
    """Protected attributes never enter features unless explicitly allowed."""
    return df if allow else df.drop(*[c for c in protected if c in df.columns])


def prediction_interval(point, rmse, lo: float, hi: float) -> tuple[Column, Column, Column]:
    """(clipped point, lower, upper) = point +/- rmse, clipped (B13); rmse falls back to 0.3."""
    r = F.coalesce(_col(rmse), F.lit(RMSE_FALLBACK))
    p = _col(point)
    return clip(p, lo, hi), clip(p - r, lo, hi), clip(p + r, lo, hi)


def confidence(probability) -> Column:
    """max(p, 1 - p)."""
    p = _col(probability)
    return F.greatest(p, 1 - p)


def blend_running_mean(prior_mean, n_prior, new_value) -> Column:
    """(prior*n + new)/(n+1); the new value alone when prior is null or n <= 0."""
    m, n, x = _col(prior_mean), _col(n_prior), _col(new_value)
    return F.when(m.isNull() | n.isNull() | (n <= 0), x).otherwise((m * n + x) / (n + 1))


def trend_label(session, semester) -> Column:
    """Chart label "{session} S{semester}" (B15)."""
    return F.format_string("%s S%s", _col(session).cast("string"), _col(semester).cast("string"))
