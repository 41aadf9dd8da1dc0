"""The n-gram join where keys, lists and families are large."""

import random

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from perkline.llm import common, ngram_join
from perkline.llm.ngram_join import apart_at_least, components, join_ngrams, meetings, scan_lists, shorten, sketch


def frame(spark, rows, parts=4):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(parts)


def test_five_thousand_sets_around_one_passage_do_not_meet(spark):
    """A family whose members share three quarters of their text and link with nothing: no rows of work for it."""
    rng = random.Random(8)
    shared = np.unique(np.array([rng.getrandbits(63) for _ in range(60)], np.int64))
    rows = [(i, np.sort(np.concatenate([shared, np.array([rng.getrandbits(63) for _ in range(20)], np.int64)])).tobytes()) for i in range(5000)]
    sets = spark.createDataFrame(rows, "id long, shingles binary").repartition(4)
    members = sets.select(F.col("id").alias("rep"), F.lit(80).cast("long").alias("n"), F.col("id").alias("comp"))
    assert meetings(sets, members).count() == 0
    # two of them linked: only these meet
    twin = np.frombuffer(rows[7][1], np.int64).copy()
    twin[:4] += 1
    sets = spark.createDataFrame([*rows, (9000, np.sort(twin).tobytes())], "id long, shingles binary").repartition(4)
    met = meetings(sets, sets.select(F.col("id").alias("rep"), F.lit(80).cast("long").alias("n"), F.col("id").alias("comp")))
    assert {r.rep for r in met.select("rep").distinct().collect()} == {7, 9000} and met.count() <= 2 * 17


@pytest.mark.parametrize(("heavy", "brief"), [(1, 32), (10, 2)])
def test_hot_classes_hubs_and_lists_split(spark, monkeypatch, heavy, brief):
    """The same results when nearly every key is treated as heavy, and when tasks send what they hold early."""
    monkeypatch.setattr(common, "HEAVY_ROWS", heavy)
    monkeypatch.setattr(ngram_join, "HOLD", 2000)
    monkeypatch.setattr(ngram_join, "BRIEF", brief)
    rng = random.Random(heavy)
    pool = [f"t{i}" for i in range(3000)]
    base = rng.choices(pool, k=90)
    rows = [" ".join(base)] * 40
    for _ in range(150):  # near copies of one text: lists longer than SHORT in every task
        x = [*base]
        for _ in range(rng.randrange(1, 6)):
            x[rng.randrange(90)] = rng.choice(pool)
        rows.append(" ".join(x))
    rows += [" ".join(base[:60] + rng.choices(pool, k=rng.randrange(5, 40))) for _ in range(80)]
    rows += [" ".join(["released", "under", "the", "mit", "license", *rng.choices(pool, k=rng.randrange(8, 12))]) for _ in range(80)]
    rows += [" ".join(rng.choices(pool, k=rng.randrange(1, 30))) for _ in range(50)] + [None, ""]
    rng.shuffle(rows)
    docs = [dict(doc_id=i, text=t) for i, t in enumerate(rows)]
    got = join_ngrams(frame(spark, rows, 6)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.op1(docs)
    sets = {d["doc_id"]: brute.shingles(d["text"]) for d in docs}
    for r in got:
        same = [i for i, s in sets.items() if s and s == sets[r.doc_id]] or [r.doc_id]
        assert (r.class_id, r.n_copies) == (min(same), len(same))


def test_without_bit_filters(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FILTER_IDS", 0)
    rng = random.Random(3)
    pool = [f"t{i}" for i in range(200)]
    rows = [" ".join(rng.choices(pool, k=30)) for _ in range(30)]
    rows += [r.replace("t1", "t2", 1) for r in rows]
    docs = [dict(doc_id=i, text=t) for i, t in enumerate(rows)]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in join_ngrams(frame(spark, rows)).collect()} == brute.op1(docs)


def test_shortened_lists_keep_every_member():
    rng = np.random.default_rng(2)
    sig, ids = rng.integers(0, 30, 4000).astype(np.uint64), rng.integers(0, 900, 4000)
    left, runs, inner = set(), {}, {}
    parts = [shorten(sig[i : i + 1000], ids[i : i + 1000]) for i in range(0, 4000, 1000)]
    for p in parts:
        left |= set(zip(p[3].tolist(), p[4].tolist(), strict=True))
        for r, m in zip(p[5].tolist(), p[6].tolist(), strict=True):
            runs.setdefault(r, set()).add(m)
    a, b, run, member, holder, held = scan_lists(*(np.concatenate([p[i] for p in parts]) for i in range(3)))
    left |= set(zip(a.tolist(), b.tolist(), strict=True))
    for r, m in zip(run.tolist(), member.tolist(), strict=True):
        runs.setdefault(r, set()).add(m)
    for r, g in zip(holder.tolist(), held.tolist(), strict=True):
        inner.setdefault(r, set()).add(g)
    for s in range(30):
        whole = set(ids[sig == s].tolist())
        assert runs[s].union(*(runs[g] for g in inner[s])) == whole
        reach = {min(whole)}
        while more := {y for x, y in left if x in reach} - reach:
            reach |= more
        assert whole <= reach


def test_components_with_a_hub(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY_ROWS", 50)
    edges = [(5, i) for i in range(6, 2000)] + [(1, 1999), (3000, 3001), (3001, 3002)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {5: 1, **dict.fromkeys(range(6, 2000), 1), 3001: 3000, 3002: 3000}


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 300), st.integers(0, 300), st.integers(0, 300))
def test_sketches_never_say_more_than_the_sets(seed, both, left, right):
    rng = np.random.default_rng(seed)
    shared = rng.integers(0, 2**64, both, np.uint64)
    a, b = (np.unique(np.concatenate([shared, rng.integers(0, 2**64, k, np.uint64)])) for k in (left, right))
    assert apart_at_least(sketch(a), sketch(b)) <= len(np.setxor1d(a, b)) and apart_at_least(sketch(a), sketch(a)) == 0
