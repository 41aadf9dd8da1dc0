"""Repeated ids among vectors long enough to be pruned."""

import random

import brute
from perkline.llm.topk_search import top_k


def test_repeated_ids_do_not_raise_the_bar(spark):
    rng = random.Random(4)
    base = [rng.gauss(0, 1) * (4 if j < 6 else 0.3) for j in range(48)]
    rows = [{"vec_id": 7, "embedding": [3 * x for x in base]}] * 8 + [{"vec_id": i, "embedding": [0.5 * x + rng.gauss(0, 1) for x in base]} for i in (0, 50, 100)]
    rows += [{"vec_id": i, "embedding": [rng.gauss(0, 1) for _ in range(48)]} for i in range(201, 900) if i % 50]
    df = spark.createDataFrame([(r["vec_id"], r["embedding"]) for r in rows], "vec_id long, embedding array<double>").coalesce(1)
    assert {(r.query_id, r.rank): (r.vec_id, r.score) for r in top_k(df).collect()} == brute.op3(rows)


def test_an_id_with_several_vectors_answers_once_by_its_best(spark):
    rows = [(0, [1.0, 0.0])] + [(1, [float(i), 0.0]) for i in range(1, 6)] + [(2, [0.5, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = [(r.rank, r.vec_id, r.score) for r in top_k(df).orderBy("rank").collect()]
    assert got == [(1, 1, 5 * 256 * 256), (2, 2, 128 * 256)]


def test_components_of_any_size(spark):
    rows = [{"vec_id": i, "embedding": [(-1.0) ** i * 2.0**e, 1.0, float(i)]} for i, e in enumerate([0, 3, 20, 40, 55, 60, 20, 900, 1010])]
    rows += [{"vec_id": 50, "embedding": [2.0**-1, 3.0, 2.0**30]}, {"vec_id": 51, "embedding": [1e308, 1.0, 1.0]}]
    df = spark.createDataFrame([(r["vec_id"], r["embedding"]) for r in rows], "vec_id long, embedding array<double>").repartition(2)
    near = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    want = {}
    ok = {r["vec_id"]: [int(256 * x // 1) for x in r["embedding"]] for r in rows[:-1]}
    for q in (0, 50):
        got = sorted((-near(sum(a * b for a, b in zip(ok[q], w, strict=True))), i) for i, w in ok.items() if i != q)[:5]
        want |= {(q, n + 1): (i, -s) for n, (s, i) in enumerate(got)}
    assert {(r.query_id, r.rank): (r.vec_id, r.score) for r in top_k(df).collect()} == want
