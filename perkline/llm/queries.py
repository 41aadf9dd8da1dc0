"""The queries of the training-data operators: name -> function (spark, sf_dir) -> DataFrame, and SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perkline.llm.common import ship
from perkline.llm.chat_format import chat_digest
from perkline.llm.fingerprint import edit_pairs
from perkline.llm.language_id import document_fields, fit_text_model, identify, page_fields
from perkline.llm.license_scan import scan_licenses
from perkline.llm.mixing import mix
from perkline.llm.ngram_join import join_ngrams
from perkline.llm.piece_codec import encode_pieces
from perkline.llm.ppm_score import score_documents
from perkline.llm.secret_scan import scan_secrets
from perkline.llm.sql import ORACLES  # noqa: F401
from perkline.llm.topk_search import top_k


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_ngrams(_table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_table(spark, sf_dir, "documents")).drop("found")


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"), every=50, k=5)


def op4_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(_table(spark, sf_dir, "documents"), verify_every=1, keep_ids=False)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat_digest(chats.unionByName(more))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"))


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_pairs(_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by all evidence and documents by theirs; doc_id is null for pages, page_id for documents."""
    docs = _table(spark, sf_dir, "documents")
    rows = page_fields(_table(spark, sf_dir, "pages")).unionByName(document_fields(docs))
    out = identify(rows, fit_text_model(docs))
    ids = [F.when(~F.col("markup"), F.col("id")).alias("doc_id"), F.when(F.col("markup"), F.col("id")).alias("page_id")]
    return out.select(*ids, "lang", "probability", "text_lang", "declared", "host", "rejected")


QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_secret_scan, op3_topk_search, op4_ppm_score, op5_sentencepiece, op6_license_scan, op7_chat_format, op8_mixing, op9_fingerprint, op10_language_id)}
