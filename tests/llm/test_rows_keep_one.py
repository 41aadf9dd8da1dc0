"""Null and repeated ids in the stages that drop rows."""

import corpus_pipeline
from perkline.llm.ngram_join import keep_one

LONG = "the quick brown fox jumps over the lazy dog and runs far away into the deep green wood"
OTHER = "seven clean sentences about boats on a lake that no other text in this table repeats at all"


def test_one_row_of_each_group_stays(spark):
    rows = [(1, LONG), (1, LONG), (2, LONG), (2, OTHER), (None, LONG), (None, "twice without an id but long enough to link"), (None, "twice without an id but long enough to link"), (None, None), (3, "")]
    got = keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, LONG), (2, OTHER), (None, rows[5][1]), (None, None), (3, "")], key=str)


def test_language_rejects_rows_and_not_ids(spark):
    english = "the and of that with thing this is what they have been for all the people in the house "
    rows = [(i, english * 3, "en", "a") for i in range(60)] + [(5, "一二三" * 60, None, "b"), (None, "四五六" * 60, None, "b"), (None, english, "en", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(2)
    got = corpus_pipeline.language(spark, df, "").collect()
    assert len(got) == 61 and all(r.text.startswith("the") for r in got) and sum(r.doc_id == 5 for r in got) == 1


def test_stages_keep_columns_of_any_name(spark, sf_dir, tmp_path):
    rows = [(i, f"the number {i} of some words that differ in each of these rows", "en", "ab"[i % 2], None, 1, "q", 2) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `a.b` int, `c``d` string, _metadata int")
    df.write.parquet(str(tmp_path / "t"))  # rows of files are numbered by place
    for frame in (df, spark.read.parquet(str(tmp_path / "t"))):
        now = frame
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, sf_dir)
            assert now.columns == df.columns, name
        assert now.count() > 0 and {r["a.b"] for r in now.collect()} == {1}


def test_rows_of_files_have_one_number_in_every_scan(spark, tmp_path):
    from perkline.llm.common import keyed

    spark.range(0, 5000, 1, 7).write.parquet(str(tmp_path / "t"))
    rows, row = keyed(spark.read.parquet(str(tmp_path / "t")))
    first = {r.id: r[row] for r in rows.collect()}
    assert len(set(first.values())) == 5000 and {r.id: r[row] for r in rows.where("id % 3 = 0").repartition(2).collect()} == {i: n for i, n in first.items() if i % 3 == 0}
    twice, row = keyed(rows.select("id").union(rows.select("id")))
    assert twice.select(row).distinct().count() == 10000


def test_stashed_tables_go_when_nothing_reads_them(spark):
    import gc
    import time

    from perkline.llm import common

    kept, lost = common.stash(spark.range(10)), common.stash(spark.range(20))
    derived, path = kept.where("id > 3"), lost._scratch
    del kept, lost
    for _ in range(20):
        common.free_shuffles(spark)
        gc.collect()
        common.sweep()
        if path not in {x[1] for x in common._TABLES}:
            break
        time.sleep(0.3)
    assert path not in {x[1] for x in common._TABLES} and derived.count() == 6
