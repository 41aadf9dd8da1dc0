"""The corpus pipeline: each stage on what the one before kept, and its decisions in force."""

import random

import brute
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from perkline.llm.mixing import mixed_documents
from perkline.llm.ngram_join import keep_one
from perkline.llm.secret_scan import redact_secrets

DDL = "doc_id long, text string, lang string, source string, n_chars long, _gone string, _key string, _size int"


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_stage_names_and_columns(spark, docs, sf_dir, tmp_path_factory):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_join", "secret_scan", "mixing", "sentencepiece"]
    assert "pipeline" in entry.queries() and "pipeline" not in entry.oracle_sql()
    home, now = tmp_path_factory.mktemp("stages"), docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, sf_dir).write.parquet(str(home / name))
        now = seen[name] = spark.read.parquet(str(home / name))
        if name != "sentencepiece":
            assert now.columns == docs.columns
    rows = [r.asDict() for r in docs.collect()]
    assert seen["language_id"].count() == len(rows)  # clean documents stay
    want = {i for i, (_, c) in brute.op1(rows).items() if c == i}
    assert {r.doc_id for r in seen["ngram_join"].collect()} == want
    clean = {r.doc_id: r for r in seen["secret_scan"].collect()}
    assert clean.keys() == want and all(not brute.base_secrets(r.text) and r.n_chars == len(r.text) for r in clean.values())
    size, target = brute.op8_targets([r.asDict() for r in clean.values()])
    got = {}
    for r in seen["mixing"].collect():
        got[r.source] = got.get(r.source, 0) + len(brute.words(r.text))
        assert clean[r.doc_id].text.startswith(r.text)
    assert all(abs(got.get(s, 0) - t) <= 1 for s, t in target.items())
    mixed, last = seen["mixing"].count(), seen["sentencepiece"]
    assert last.count() == mixed and last.where("not round_trip or size(pieces) != n_pieces").count() == 0
    assert entry.queries()["pipeline"](spark, sf_dir).count() == mixed


def test_stages_take_awkward_rows(spark):
    rng = random.Random(2)
    words = [f"word{i}" for i in range(80)]
    rows = [(None, "some text here now and then", None, None, 5, "g", "k", 1), (1, None, None, "a", None, "g", "k", 1), (2, "", "en", "a", 0, "g", "k", 1), (3, "password=hunter2222x", "en", None, 20, "g", "k", 1)]
    rows += [(i, " ".join(rng.choices(words, k=rng.randrange(1, 40))), "en", rng.choice("aaab"), None, "g", "k", 1) for i in range(4, 60)] + [(59, "repeat of an id", "en", "b", 1, "g", "k", 1)]
    df = spark.createDataFrame(rows, DDL)
    assert redact_secrets(df).columns == keep_one(df).columns == mixed_documents(df).columns == df.columns
    assert redact_secrets(df).count() == len(rows) and redact_secrets(df).where("doc_id = 3").first().text == "[secret]"
    assert keep_one(df).where("doc_id is null").count() == 1 and keep_one(df).where("doc_id in (1, 2)").count() == 2
    now = df
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, "")
    assert now.count() > 0
    empty = df.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0
    assert mixed_documents(df).where(F.col("text") == "").count() == 0


def test_each_row_is_cut_at_its_own_secrets(spark):
    """Null and repeated ids."""
    rows = [(None, "see password=hunter2222x now", "a"), (None, "plain text without any", "a"), (1, "token=abcdefgh12 at the start", "a"), (1, "harmless words that stay as they are", "b"), (1, "late in the text: secret=zyxwvut987", "b")]
    got = sorted(r.text for r in redact_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(2)).collect())
    assert got == sorted(["see [secret] now", "plain text without any", "[secret] at the start", "harmless words that stay as they are", "late in the text: [secret]"])
