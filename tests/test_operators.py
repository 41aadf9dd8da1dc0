from datetime import date
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from perkline.functions.clean import cents, month_of, ratio, tidy, typed
from perkline.operators.caps import allocate_capped
from perkline.operators.dedup import latest_by
from perkline.operators.fx import convert_signed
from perkline.operators.history import versions
from perkline.operators.match import asof_join, best_match, orphans
from perkline.operators.rank import rank_by, share_of, top1_by
from perkline.operators.validate import reason_histogram, split_valid, tag_rejects


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_text_and_types(frame):
    df = frame("a string, n string, t string", (" abc ", "1.5", "2026-09-01T10:00:00"), (None, "x", "never"))
    out = df.select(tidy("a", "upper").alias("u"), tidy("a", "title").alias("t"), tidy("a", "code4").alias("c"), typed("n", "double").alias("n"), typed("t", "timestamp").isNull().alias("bad"))
    assert rows(out) == [(None, None, None, None, True), ("ABC", "Abc", "0abc", 1.5, False)]
    assert frame("c string", ("123456",)).select(tidy("c", "code4")).first()[0] == "1234"


def test_money_and_ratio(frame):
    df = frame("x decimal(10,3), y double, d date", (Decimal("1.005"), 0.0, date(2026, 9, 1)), (Decimal("2.345"), 4.0, date(2026, 10, 1)))
    out = df.select(cents("x").cast("string").alias("a"), ratio("x", "y", 100, 3).alias("b"), month_of("d").alias("c"))
    assert rows(out) == [("1.01", None, "2026-09"), ("2.35", 58.625, "2026-10")]


def test_latest_keeps_one_row_per_key(frame):
    df = frame("k string, v int", ("a", 1), ("a", 3), ("b", 2), (None, 5), (None, 6))
    assert rows(latest_by(df, ["k"], [F.col("v").desc()])) == [("a", 3), ("b", 2)]
    assert rows(latest_by(df, ["k"], [F.col("v").desc()], keep_null_keys=True)) == [(None, 5), (None, 6), ("a", 3), ("b", 2)]


def test_latest_prunes_before_the_shuffle(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    plan = latest_by(df, ["l_orderkey"], [F.col("l_shipdate").desc()])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_conversion_signs_and_gaps(frame):
    tx = frame("c string, d date, a double, r boolean", ("EUR", date(2026, 9, 1), 50.0, False), ("USD", date(2026, 9, 1), 20.0, True), ("XBT", date(2026, 9, 1), 10.0, False), ("USD", date(2026, 9, 1), None, False))
    fx = frame("rate_date date, currency string, usd_rate double", (date(2026, 9, 1), "USD", 1.0), (date(2026, 9, 1), "EUR", 1.10))
    out = {(r.c, r.a): r.amount_usd for r in convert_signed(tx, fx, "c", "d", "a", F.col("r")).collect()}
    assert out == {("EUR", 50.0): 55.0, ("USD", 20.0): -20.0, ("XBT", 10.0): None, ("USD", None): None}


def test_first_failing_rule_wins_and_nothing_is_lost(frame):
    df = frame("a int, b int", (1, 1), (None, 1), (None, None), (1, None), (2, 5))
    tagged = tag_rejects(df, [("no_a", F.col("a").isNull()), ("no_b", F.col("b").isNull()), ("big", F.col("b") > 4)])
    valid, bad = split_valid(tagged)
    assert rows(valid) == [(1, 1)]
    assert rows(reason_histogram(bad)) == [("big", 1), ("no_a", 2), ("no_b", 1)]
    assert valid.count() + bad.count() == df.count()


def snapshots(frame, *rows_):
    return frame("k string, d date, x string, y double", *[(k, date(2026, 9, d), x, y) for k, d, x, y in rows_])


def test_versions(frame):
    df = snapshots(frame, ("C1", 1, "a", 250.0), ("C1", 2, "a", 250.0), ("C1", 3, "a", 300.0), ("C2", 1, "b", 0.0), ("C2", 3, "b", 0.0), ("C3", 1, None, 1.0), ("C3", 2, "", 1.0), ("C3", 3, None, 1.0))
    out = versions(df, "k", "d", ["x", "y"]).select("k", "version_no", "y", F.dayofmonth("valid_from"), F.col("valid_to").cast("string"), "is_current", F.dayofmonth("last_seen_date"))
    got = rows(out, "k", "version_no")
    assert got[:3] == [("C1", 1, 250.0, 1, "2026-09-02", False, 2), ("C1", 2, 300.0, 3, "9999-12-31", True, 3), ("C2", 1, 0.0, 1, "9999-12-31", True, 3)]
    assert [g[1] for g in got[3:]] == [1, 2, 3]  # null is not the empty text, and a return is a new version


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(1, 20), st.sampled_from("xyz")), min_size=1, max_size=25, unique_by=lambda r: r[:2]))
def test_versions_are_disjoint_and_contiguous(spark, data):
    df = spark.createDataFrame([(k, date(2026, 9, d), x) for k, d, x in data], "k string, d date, x string")
    out = versions(df, "k", "d", ["x"]).orderBy("k", "version_no").collect()
    for a, b in zip(out, out[1:], strict=False):
        if a.k == b.k:
            assert (b.valid_from - a.valid_to).days == 1 and a.x != b.x and not a.is_current
    assert sum(r.is_current for r in out) == len({k for k, _, _ in data})


def test_asof_join_at_both_ends(frame):
    facts = frame("k string, at date", ("a", date(2026, 9, 1)), ("a", date(2026, 9, 15)), ("a", date(2026, 9, 16)), ("a", date(2026, 8, 31)), (None, date(2026, 9, 1)))
    dim = frame("k string, f date, t date, v string", ("a", date(2026, 9, 1), date(2026, 9, 15), "one"), ("a", date(2026, 9, 16), date(9999, 12, 31), "two"))
    out = asof_join(facts, dim, "k", "at", "f", "t", ["v"])
    assert rows(out.select("at", "v")) == [(date(2026, 8, 31), None), (date(2026, 9, 1), None), (date(2026, 9, 1), "one"), (date(2026, 9, 15), "one"), (date(2026, 9, 16), "two")]


def test_best_match(frame):
    facts = frame("id int, k string, at date", (1, "a", date(2026, 9, 1)), (2, "b", date(2026, 9, 1)), (3, "a", date(2025, 12, 31)), (4, None, date(2026, 9, 1)))
    d = date(2026, 1, 1)
    rules = frame(
        "k string, s date, e date, rid string, m double, cap double",
        ("a", d, None, "R2", 3.0, 500.0), ("a", d, None, "R1", 3.0, None), ("a", d, None, "R0", 2.0, None), ("a", d, date(2026, 8, 31), "R9", 9.0, None), ("a", None, None, "R8", 8.0, None), ("b", d, None, "R5", None, None),
    )
    out = best_match(facts, rules, ["k"], "at", "s", "e", "m", "rid", ["rid", "m", "cap"])
    assert rows(out.select("id", "rid", "m"), "id") == [(1, "R1", 3.0), (2, "R5", None), (3, None, None), (4, None, None)]


def caps(frame, amounts, cap, **how):
    df = frame("p string, n int, a double, c double", *[("p", i, a, cap) for i, a in enumerate(amounts)])
    return [r.got for r in allocate_capped(df, ["p"], ["n"], "a", "c", F.lit(True), "got", **how).orderBy("n").collect()]


def test_cap_splits_the_row_that_crosses(frame):
    assert caps(frame, [300.0, 300.0, 100.0], 500.0) == [300.0, 200.0, 0.0]
    assert caps(frame, [100.0, 400.0, 200.0], 500.0) == [100.0, 400.0, 0.0]
    assert caps(frame, [300.0, 300.0], None) == [300.0, 300.0]
    assert caps(frame, [300.0, 300.0, -200.0, 300.0], 500.0) == [300.0, 200.0, 0.0, 0.0]
    assert caps(frame, [300.0, 300.0, -200.0, 300.0], 500.0, clamp_negative=False) == [300.0, 200.0, 0.0, 100.0]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=1, max_size=12), st.integers(1, 1000))
def test_cap_gives_out_all_there_is(spark, amounts, cap):
    df = spark.createDataFrame([("p", i, float(a), float(cap)) for i, a in enumerate(amounts)], "p string, n int, a double, c double")
    assert allocate_capped(df, ["p"], ["n"], "a", "c", F.lit(True), "got").agg(F.sum("got")).first()[0] == min(sum(amounts), cap)


def test_shares_ranks_and_tops(frame):
    df = frame("g string, k string, v double", ("a", "x", 1.0), ("a", "y", 1.0), ("a", "z", 2.0), ("b", "x", 0.0))
    out = rank_by(share_of(df, ["g"], "v", "pct"), ["g"], [F.col("v").desc()], "r")
    assert rows(out.select("g", "k", "pct", "r"), "g", "k") == [("a", "x", 25.0, 2), ("a", "y", 25.0, 2), ("a", "z", 50.0, 1), ("b", "x", None, 1)]
    assert rows(top1_by(df, ["g"], [F.col("v"), F.col("k")])) == [("a", "x", 1.0), ("b", "x", 0.0)]


def test_orphans_ignore_nulls(frame):
    got = orphans(frame("a string", ("x",), ("y",), ("y",), (None,)), "a", frame("b string", ("x",), (None,)), "b")
    assert rows(got) == [("y",)]


@pytest.mark.parametrize("column", ["l_shipdate", "l_quantity"])
def test_filters_and_columns_reach_the_scan(spark, sf_dir, column):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where(F.col(column).isNotNull() & (F.col("l_returnflag") == "R"))
    plan = latest_by(df, ["l_orderkey"], [F.col(column).desc()]).select("l_orderkey", column)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_returnflag,R)" in plan and "l_extendedprice" not in plan.split("ReadSchema")[1]
