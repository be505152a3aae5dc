"""Driver contract + brute-force (DuckDB) check of registered queries on the sf0.001 fixture."""

import math

import pytest

import __spark_entry__ as E
from tests.conftest import SF001

# A representative slice across every family; the full set runs in tools/oracle_check.py.
SAMPLE = ["panel_core", "session_trends", "grade_bands", "enrolment_join", "assembled_panel", "latest_event_per_user",
          "term_rollup", "course_difficulty", "correlation_matrix", "prior_difficulty", "peer_deviation",
          "validate_customer_csv", "import_summary", "score_updates", "panel_features", "open_period_features",
          "roc_curve", "calibration_curve", "group_rates", "fairness_report", "top_contributors", "narratives",
          "at_risk_register", "register_report", "temporal_split", "comparison_table", "stream_engagement_windows"]


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "asDict"):
        return tuple(sorted((k, _norm(x)) for k, x in v.asDict().items()))
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def test_contract_shapes():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 100
    assert "panel_features" in o


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "risk_label" in df.columns


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, duck, name):
    df = E.queries()[name](spark, SF001)
    srows = [tuple(r) for r in df.collect()]
    cur = duck.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(ocols)
    assert _rows(df.columns, srows) == _rows(ocols, cur.fetchall())
