"""Units of segments: single firms."""

from __future__ import annotations

import pytest

from lodegraph.operators import segments

CASES = {
    # firm: (rows of name, revenue, ratio; the firm's revenue; status; revenues; trusted shares)
    "ok": ([("a", 60, 60.0), ("b", 40, 40.0)], 100, "ok", [60, 40], True),
    "thousands": ([("a", 60, None), ("b", 40, None)], 98_000, "scaled", [60_000, 40_000], None),
    "millions": ([("a", 3, None), ("b", None, None)], 3_000_000, "scaled", [3_000_000, None], None),
    "shares": ([("a", 7, 33.3), ("b", 9, 66.7)], 1_000, "rebuilt", [333, 667], True),
    "unknown": ([("a", 7, 33.3), ("b", 9, 10.0)], 1_000, "unknown", [7, 9], False),
    "nothing": ([("a", None, 50.0)], 1_000, "no_total", [None], False),
    "no_year": ([("a", 5, 100.0)], None, "no_total", [5], True),
    "total_line": ([("a", 30, 35.8), ("b", 70, 64.1), ("sum", 100, 100.0)], 100, "ok", [30, 70, 100], True),
    "two_rows": ([("a", 50, 100.0), ("sum", 50, 100.0)], 100, "ok", [50, 50], False),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(firm, 2024, *r) for firm, (rs, *_) in CASES.items() for r in rs]
    totals = [(firm, 2024, t) for firm, (_, t, *_) in CASES.items() if t is not None] + [("ok", 2023, 5)]
    df = segments.repaired_units(spark.createDataFrame(rows, "corp string, year int, name string, revenue long, ratio double"), spark.createDataFrame(totals, "corp string, year int, revenue long"))
    return {(r.corp, r.name): r for r in df.collect()}


@pytest.mark.parametrize("firm", CASES)
def test_firm(found, firm):
    rows, _, status, revenues, shares = CASES[firm]
    got = [found[firm, name] for name, *_ in rows]
    assert [r.revenue for r in got] == revenues
    assert {r.status for r in got} == {status} and {r.ratio_trusted for r in got} == {shares}
    assert [r.is_total for r in got] == [firm == "total_line" and name == "sum" for name, *_ in rows]
    assert all(r.revenue_trusted == (status in ("ok", "scaled", "rebuilt") and not r.is_total) for r in got)
