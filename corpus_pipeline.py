"""A training corpus from `documents`: five stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perkline.llm.common import cols_of, fresh, keyed, replaced, ship, small_side, stash
from perkline.llm.language_id import document_fields, fit_text_model, identify
from perkline.llm.mixing import mixed_documents
from perkline.llm.ngram_join import keep_one
from perkline.llm.piece_codec import encode_pieces
from perkline.llm.secret_scan import redact_secrets


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no language explains go, each row by its own text; those without a language code get the one that
    the evidence gives them."""
    ship(spark)
    rows, row = keyed(docs)
    key, gone, told = (fresh(rows, n) for n in ("_key", "_gone", "_told"))
    found = identify(document_fields(rows, doc=row), fit_text_model(docs)).where("rejected or declared = ''")
    found = small_side(found.select(F.col("id").alias(key), F.col("rejected").alias(gone), F.col("lang").alias(told)))
    both = rows.join(found, F.col(row) == F.col(key), "left").where(~F.coalesce(F.col(gone), F.lit(False)))
    return replaced(both, lang=F.coalesce("lang", told)).select(*cols_of(docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays: that with the smallest id."""
    ship(spark)
    return keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are blanked; every document stays."""
    ship(spark)
    return redact_secrets(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents appear as often as the mix serves them. Their order would not outlive
    the table between two stages, so texts are not sorted by it."""
    return mixed_documents(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of each text of the mix."""
    ship(spark)
    return encode_pieces(docs, verify_every=1)


STAGES = [("language_id", language), ("ngram_join", near_duplicates), ("secret_scan", secrets), ("mixing", mixture), ("sentencepiece", pieces)]
#: Hashing of shingles, the language model and the tokenizer have no SQL form; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stash(docs)
    return docs
