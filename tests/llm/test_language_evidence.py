"""Language ID against a plain-Python naive Bayes with hierarchical priors, and pages that leave their tags open."""

import random
import time

import brute
import pyarrow.parquet as pq
import pytest

from perkline.llm import common
from perkline.llm.language_id import document_fields, fit_text_model, identify, page_fields, visible_text

DDL = "id long, text string, markup boolean, declared string, host string, suffix string"


def rows_of(docs, seed):
    """Fields with missing, false and rare evidence, hosts of all sizes, and texts cut to a few words."""
    rng = random.Random(seed)
    rows = []
    for i, d in enumerate(docs):
        words = (d["text"] or "").split(" ")
        text = " ".join(words[: rng.choice([1, 2, 5, 400])])
        rows.append((i, text, rng.choice([d["lang"], d["lang"], "en", "xx", ""]), rng.choice(["big.de", "big.de", f"h{i % 9}.fr", "one.es"]), rng.choice(["de", "fr"])))
    return rows + [(900, "", "en", "big.de", "de"), (901, "一二三" * 40, "", "", ""), (902, "ab", "", "big.de", "de"), *[(903, "twice the same row of it", "en", "big.de", "de")] * 2]


@pytest.mark.parametrize("heavy", [1000, 5])
def test_against_brute_force(spark, sf_dir, monkeypatch, heavy):
    monkeypatch.setattr(common, "HEAVY_ROWS", heavy)
    docs = pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()
    rows = rows_of(docs, heavy)
    model = fit_text_model(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    fields = spark.createDataFrame([(i, t, False, d, h, s) for i, t, d, h, s in rows], DDL).repartition(3)
    want = sorted((i, *x) for (i, *_), x in zip(rows, brute.op10(rows, brute.op10_model(docs)), strict=True))
    got = sorted((r.id, r.lang, r.probability, r.text_lang) for r in identify(fields, model).collect())
    assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], rel=1e-6, abs=1e-9)


def test_planted_junk_goes_and_clean_rows_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rng = random.Random(6)
    junk = [(10**6 + i, "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(200)), None, "src1", 200) for i in range(20)]
    both = docs.unionByName(spark.createDataFrame(junk, docs.schema))
    got = identify(document_fields(both), fit_text_model(both)).collect()
    assert {r.id for r in got if r.rejected} == {j[0] for j in junk}
    told = {r.doc_id: r.lang for r in docs.collect()}
    assert sum(told[r.id] == r.lang for r in got if r.id in told) >= 0.99 * len(told)


def test_pages(spark):
    page = '<html xml:lang="DE-at"><head><style>.x{}</style><!-- not me --></head><body>Gr&uuml;&szlig;e <b>an</b> alle<script>var x = "no";</script></body></html>'
    rows = [(1, "https://user@News.Example.AT:8080/a?b", page), (2, None, None), (3, "nothing", "<html data-lang='fr' lang=en>")]
    got = {r.id: r for r in page_fields(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert (got[1].declared, got[1].host, got[1].suffix) == ("de", "news.example.at", "at") and got[3].declared == "en" and got[2].declared is None
    assert visible_text(page).split() == ["Grüße", "an", "alle"] and visible_text(None) == ""
    assert visible_text("a<!-- b -->c<script>d</script e><style>f") == "a c d  f" and visible_text("1 < 2 <b> x <i") == "1   x <i"


@pytest.mark.parametrize("part", ["<script ", "<!-- ", "<", "<style><script>", "</script ", "<html ", "&amp", "<script></script"])
def test_hostile_pages_take_linear_time(spark, part):
    page = part * (5_000_000 // len(part))
    began = time.perf_counter()
    visible_text(page)
    assert time.perf_counter() - began < 5
    if part == "<html ":
        page_fields(spark.createDataFrame([(1, "http://a.b", page)], "page_id long, url string, html string")).collect()
        assert time.perf_counter() - began < 20
