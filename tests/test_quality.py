import json
from datetime import datetime

import pytest

from perkline.quality import DataQualityError, SpecError, enforce, evaluate, gate, write_report


@pytest.fixture
def df(frame):
    """Parcels: weights from -1.5 to 40, a state missing, a number twice."""
    rows = [(i, f"p{i // 2 if i in (4, 5) else i}", ("sent", "held", None)[i % 3], w) for i, w in enumerate((0.25, 40.0, None, 12.5, -1.5, 7.0, 7.0))]
    return frame("i int, parcel string, state string, weight double", *rows)


def one(df, **spec):
    lookup = spec.pop("lookup", None)
    o = evaluate(df, "t", [spec], lookup, now=datetime(2026, 9, 20))[0]
    return o.passed, o.observed


@pytest.mark.parametrize(
    ("spec", "want"),
    [
        ({"type": "row_count_min", "value": 7}, (True, 7)),
        ({"type": "row_count_min", "value": 3, "where": "weight > 7"}, (False, 2)),
        ({"type": "not_null", "column": "i"}, (True, 0)),
        ({"type": "not_null", "column": "state", "where": "i < 6", "severity": "warn"}, (False, 2)),
        ({"type": "unique", "column": "i"}, (True, 0)),
        ({"type": "unique", "column": "parcel"}, (False, 2)),
        ({"type": "unique_composite", "columns": ["parcel", "weight"]}, (True, 0)),
        ({"type": "unique_composite", "columns": ["state"]}, (False, 4)),
        ({"type": "accepted_values", "column": "state", "values": ["sent", "held", "lost"]}, (True, 0)),
        ({"type": "accepted_values", "column": "state", "values": ["held"]}, (False, 3)),
        ({"type": "range", "column": "weight", "min": -1.5, "max": 40}, (True, 0)),
        ({"type": "range", "column": "weight", "min": 0, "max": 12}, (False, 3)),
        ({"type": "range", "column": "weight", "min": 7}, (False, 2)),
        ({"type": "range", "column": "weight", "max": 7.0}, (False, 2)),
        ({"type": "referential_integrity", "column": "parcel", "ref_table": "a.known", "ref_column": "k"}, (False, 2)),
    ],
)
def test_checks(df, frame, spec, want):
    known = frame("k string", ("p0",), ("p1",), ("p2",), (None,), ("other",))
    assert one(df, **spec, lookup=lambda _: known) == want


def test_two_nulls_are_not_unique(frame):
    assert one(frame("k string", (None,), (None,), ("a",)), type="unique", column="k") == (False, 1)


def test_corrupt_ratio(frame, df):
    dirty = frame("_corrupt_record string, v int", ("x", None), (None, 1), (None, 2), (None, 3))
    assert one(dirty, type="corrupt_ratio_max", value=0.2) == (False, 0.25)
    assert one(df, type="corrupt_ratio_max", value=0.0) == (True, 0.0)
    assert one(df.limit(0), type="corrupt_ratio_max", value=0.0) == (True, 0.0)


def test_freshness(frame):
    old = frame("d date, s string, n string", (datetime(2026, 9, 10).date(), "2026-09-18T10:00:00", None))
    assert one(old, type="freshness_days_max", column="d", value=10) == (True, 10)
    assert one(old, type="freshness_days_max", column="s", value=1) == (False, 2)
    assert one(old, type="freshness_days_max", column="n", value=1) == (False, None)


def test_malformed_specs(df):
    for spec in ({"type": "nothing"}, {"type": "unique"}, {"type": "range", "column": "a"}, {"type": "not_null", "column": "a", "severity": "loud"}):
        with pytest.raises(SpecError):
            evaluate(df, "t", [spec])


def test_severity_report_and_gate(df, tmp_path):
    specs = [{"type": "not_null", "column": "state", "severity": "warn"}, {"type": "row_count_min", "value": 1}]
    outcomes = evaluate(df, "a.b", specs)
    enforce(outcomes)
    assert [r["passed"] for r in json.loads(write_report(str(tmp_path), "a.b", outcomes).read_text())["results"]] == [False, True]
    with pytest.raises(DataQualityError, match="not_null"):
        gate("a.c", [{"type": "not_null", "column": "state"}], str(tmp_path))(df)
    assert (tmp_path / "_quality" / "a.c.json").exists()  # told before it is raised


def test_single_pass_checks_share_one_job(spark, df):
    specs = [{"type": "row_count_min", "value": 1}, {"type": "not_null", "column": "state", "severity": "warn"}, {"type": "range", "column": "weight", "max": 1}, {"type": "accepted_values", "column": "state", "values": []}]
    spark.sparkContext.setJobGroup("one-pass", "")
    evaluate(df, "t", specs)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("one-pass"))
    spark.sparkContext.setJobGroup("one-row", "")
    df.agg({"weight": "max"}).first()
    assert jobs == len(spark.sparkContext.statusTracker().getJobIdsForGroup("one-row"))
    assert not df.is_cached
