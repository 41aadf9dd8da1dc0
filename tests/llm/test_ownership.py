"""Repositories and owners together tell copied examples from an owner's own credentials."""

from collections import defaultdict

from pyspark.sql import functions as F

from perkline.llm.secret_scan import redact_secrets, scan_secrets

DDL = "doc_id long, text string, owner string, repo string"
MIRRORED, COPIED, SPREAD = "Zx9Qw3Er7Ty1Ui5Op0AsDf", "Ab3Cd4Ef5Gh6Ij7Kl8MnOp", "Qq1Ww2Ee3Rr4Tt5Yy6Uu7I"


def test_owners_alone_mislead(spark):
    rows = [(1, f"see {MIRRORED} here", "a", "tool"), (2, f"see {MIRRORED} here", "b", "tool"), (3, f"copy {COPIED}", "a", "x"), (4, f"copy {COPIED}", "b", "y"), (5, f"own {SPREAD}", "c", "p"), (6, f"own {SPREAD}", "c", "q")]
    df = spark.createDataFrame(rows, DDL)
    got = {r.doc_id: (r.spans, r.n_live, r.n_example) for r in scan_secrets(df, owner="owner", repo="repo").collect()}
    assert got == {1: ("owned:4:26", 1, 0), 2: ("owned:4:26", 1, 0), 3: ("", 0, 0), 4: ("", 0, 0), 5: ("owned:4:26", 1, 0), 6: ("owned:4:26", 1, 0)}
    left = {r.doc_id: r.text for r in redact_secrets(df, owner="owner", repo="repo").collect()}
    assert left[1] == "see [secret] here" and left[3] == f"copy {COPIED}" and left[5] == "own [secret]"


def test_a_value_in_a_third_of_all_rows(spark):
    """Its counts come back by broadcast; all the same against plain counting."""
    rows = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, f"key {COPIED} end").otherwise(F.concat(F.lit("password=pw9"), F.upper(F.md5(F.floor(F.col("id") / 2).cast("string"))))).alias("text"), F.concat(F.lit("o"), F.col("id") % 7).alias("owner"), F.concat(F.lit("r"), F.col("id") % 50).alias("repo"))
    out = scan_secrets(rows, owner="owner", repo="repo").collect()
    owners, repos, source = defaultdict(set), defaultdict(set), {r.doc_id: r for r in rows.collect()}
    for r in source.values():
        owners[r.text].add(r.owner)
        repos[r.text].add(r.repo)
    assert len(out) == 9000
    for r in out:
        text = source[r.doc_id].text
        copied = len(owners[text]) > 1 and len(repos[text]) > 1
        if text.startswith("key"):
            assert (r.spans, r.n_live, r.n_example) == ("", 0, 0)
        else:
            assert r.n_assign == 1 and r.n_example == copied
