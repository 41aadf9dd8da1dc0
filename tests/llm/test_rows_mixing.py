"""The mix takes each row as often as it is served itself, in the order of virtual finish times."""

import math

import brute
from perkline.llm.mixing import mix, mixed_documents


def totals(rows):
    got = {}
    for r in rows:
        got[r.source] = got.get(r.source, 0) + len(r.text.split())
    return got


def test_null_and_repeated_ids_meet_their_targets(spark):
    rows = [(None if i % 3 == 0 else i // 4, " ".join(f"r{i}w{j}" for j in range(1 + i % 7)), "abc"[i % 5 % 3]) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    _, target = brute.op8_targets([dict(doc_id=i, text=t, source=s) for i, t, s in rows])
    got = totals(mixed_documents(df).collect())
    assert all(abs(got[s] - t) <= 1 for s, t in target.items())


def test_budget_is_spent_in_order_of_finish_times(spark):
    """Against a queue of single words."""
    rows = [(i, " ".join([f"w{i}"] * (1 + i * i % 9)), "abcd"[i % 11 % 4]) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mix(df).collect()
    assert sum(r.taken for r in plan) == math.floor(1.5 * sum(r.size for r in plan))
    out = mixed_documents(df, position="at").collect()
    assert [r.at for r in out] == sorted(r.at for r in out) and out[0].at == 0
    sizes, served, at = {r.doc_id: r.size for r in plan}, {}, 0
    target = {i: r.target for r in plan for i in [r.doc_id]}
    source = {i: s for i, _, s in rows}
    last = (0, "")
    for r in out:
        n = len(r.text.split())
        assert r.at == at or n < sizes[r.doc_id]  # servings follow each other; those in service at the end are cut
        at += n
        served[r.source] = served.get(r.source, 0) + n
        if n == sizes[r.doc_id]:
            now = (served[r.source] / target[r.doc_id], source[r.doc_id])
            assert now >= last and now[0] <= 1 + 1 / target[r.doc_id]
            last = now
    first = {}
    for r in out:
        first.setdefault(r.doc_id, r.at)
    assert {r.doc_id: r.position for r in plan if r.taken} == first and all(r.position is None for r in plan if not r.taken)


def test_columns_with_odd_names(spark):
    df = spark.createDataFrame([(1, "a b c", "s", 1, 2), (2, "d e", "t", 3, 4)], "doc_id long, text string, source string, `x.y` int, `_key` int")
    out = mixed_documents(df)
    assert out.columns == df.columns and sum(len(r.text.split()) for r in out.collect()) == 7
