"""The language stage: junk goes, and documents without a code get one."""

import random

import corpus_pipeline


def test_junk_goes_and_missing_codes_are_filled(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rng = random.Random(6)
    long = [r for r in docs.collect() if len(r.text) > 400]
    bare = [(10**6 + i, r.text, None, r.source, r.n_chars) for i, r in enumerate(long[:60])]
    junk = [(2 * 10**6 + i, "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(200)), None, "src1", 200) for i in range(20)]
    both = docs.unionByName(spark.createDataFrame(bare + junk, docs.schema))
    got = {r.doc_id: r for r in corpus_pipeline.language(spark, both, sf_dir).collect()}
    assert got.keys() == {r.doc_id for r in docs.collect()} | {b[0] for b in bare}
    assert sum(got[b[0]].lang == r.lang for b, r in zip(bare, long, strict=False)) >= 59
    assert all(got[r.doc_id] == r for r in docs.collect())
