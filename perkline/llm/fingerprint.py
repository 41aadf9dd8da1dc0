"""Document fingerprints by quartile bucket digests.

A text's UTF-8 bytes are read through a sliding window; the byte triplets of each window (three neighbours, and two
with one gap) are hashed into BUCKETS counters. The digest holds a version mark, the length on a logarithmic scale,
and two bits per bucket: which quartile of all counters its count falls in. Two digests differ by a bounded score: the
length difference, at most LENGTH_MOST, and for each bucket the distance of the quartiles, 3 counting as 6.
Likeness is 1 less the score over its largest value.

Defined results: null text is empty; a text of fewer than three bytes has all counters 0 and its own short digest, a
hash of its bytes, so that equal texts have equal and different short texts different digests (a short digest is like
another only if equal); very long texts are read whole, in pieces; repeated rows have equal digests; an empty table
gives no rows; other columns are ignored.

The edited text of a document needs the next document by falling doc_id (ties by text; after the last one, the first).
Documents are dealt into ranges of doc_id and sorted there; the first document of each range also
follows the last one of the range before it. Ranges come from quantiles of the ids, so no task holds more than its share.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perkline.llm.common import lean, sha, slices

BUCKETS, LENGTH_MOST, PIECE = 256, 16, 1 << 20
#: Ranges of doc_id for each shuffle partition.
RANGES = 8
MOST = 6 * BUCKETS + LENGTH_MOST
# Fixed values of the digest: odd multipliers of the three bytes, and what turns the gapped triplets' hashes.
MULTIPLIERS, TURN = (2654435761, 2246822519, 3266489917), 0x5BD1E995
_T = tuple(np.arange(256, dtype=np.uint32) * np.uint32(m) for m in MULTIPLIERS)
_STEP = np.where(np.abs(np.subtract.outer(np.arange(4), np.arange(4))) == 3, 6, np.abs(np.subtract.outer(np.arange(4), np.arange(4))))


def bucket_counts(data: bytes) -> np.ndarray:
    """Counts of hashed triplets of neighbours (i, i+1, i+2) and of gapped ones (i, i+1, i+3)."""
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, max(len(data) - 2, 0), PIECE):
        a = np.frombuffer(data, np.uint8)[at : at + PIECE + 3]
        x, y, z = _T[0][a], _T[1][a], _T[2][a]
        pair = x[:-1] ^ y[1:]
        near = pair[: min(PIECE, len(a) - 2)] ^ z[2:][:PIECE]
        total += np.bincount((near >> np.uint32(24)).view(np.int32), minlength=BUCKETS)
        gap = pair[: min(PIECE, len(a) - 3)] ^ z[3:][:PIECE]
        total += np.bincount(((gap ^ np.uint32(TURN)) >> np.uint32(24)).view(np.int32), minlength=BUCKETS)
    return total


def fingerprint(text: str) -> str:
    data = text.encode("utf-8", "surrogatepass")
    if len(data) < 3:
        return "s" + data.hex()
    counts = bucket_counts(data)
    ordered = np.sort(counts)
    q = ordered[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    level = (counts[:, None] > q[None, :]).sum(1).astype(np.uint8)
    packed = level[0::4] | level[1::4] << 2 | level[2::4] << 4 | level[3::4] << 6
    return f"q{min(255, round(8 * math.log2(len(data)))):02x}" + packed.astype(np.uint8).tobytes().hex()


def _levels(fp: str) -> np.ndarray:
    b = np.frombuffer(bytes.fromhex(fp[3:]), np.uint8)
    return np.stack([b >> s & 3 for s in (0, 2, 4, 6)], 1).ravel()


def likeness(a: str, b: str) -> float:
    """1 for equal digests, 0 for the largest difference."""
    if a == b:
        return 1.0
    if a[0] == "s" or b[0] == "s":
        return 0.0
    score = min(LENGTH_MOST, abs(int(a[1:3], 16) - int(b[1:3], 16))) + int(_STEP[_levels(a), _levels(b)].sum())
    return 1.0 - score / MOST


def fingerprints(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, fingerprint of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text=1):
            texts = [t or "" for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([fingerprint(t) for t in texts], pa.string())], ["doc_id", "n_chars", "fingerprint"])

    return docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, n_chars long, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last half (rounded down) replaced by as many first characters of the following text, or all of it."""
    h = len(text) // 2
    return text[: len(text) - h] + following[:h]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, guest, doc_id, text) sorted by range, guest, falling doc_id, text: each row meets the next of its
    range; a range's last row is a guest, or, where a range holds every document, its own first row follows the last."""
    held = None  # (range, guest, id, text, fingerprint)
    out: list[list] = [[] for _ in range(8)]

    def pair(own, following):
        e = edited(own[3], following[3])
        fe = fingerprint(e)
        for col, v in zip(out, (own[2], len(own[3]), sha(e), own[4], fe, likeness(own[4], fe), likeness(own[4], following[4]), None), strict=True):
            col.append(v)

    def flush():
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=False)], names)
        for c in out:
            c.clear()
        return batch

    for b in slices(batches, text=3):
        for r, guest, i, t in zip(*(b.column(j).to_pylist() for j in range(4)), strict=True):
            t = t or ""
            row = (r, guest, i, t, fingerprint(t))
            if held is not None and held[0] == r and not held[1]:
                pair(held, row)
            held = row
        if out[0]:
            yield flush()


def edit_pairs(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A null doc_id sorts last. See the module's text for the edited text."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("key", F.coalesce(F.col("doc_id"), F.lit(-(1 << 62))))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    n = RANGES * parts
    cuts = np.unique(np.array(rows.select(F.col("key").cast("double").alias("k")).approxQuantile("k", [i / n for i in range(1, n)], 1 / (2 * n)), np.float64))

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, key.to_numpy(np.float64), side="right").astype(np.int32))

    rows = rows.withColumn("rng", range_of("key"))
    # the first document of each range by falling id: one id a range, so at most n of them
    tops = sorted((r["rng"], r["top"]) for r in rows.groupBy("rng").agg(F.max("key").alias("top")).collect())
    # it also stands behind the last document of the range of the next larger ids; the very first behind the very last
    goes = spark.createDataFrame([(top, tops[(j + 1) % len(tops)][0]) for j, (_, top) in enumerate(tops)], "top long, guest_rng int")
    dealt = rows.join(F.broadcast(goes), rows["key"] == goes["top"], "left")
    places = F.filter(F.array(F.struct(F.col("rng").alias("rng"), F.lit(False).alias("guest")), F.struct(F.col("guest_rng").alias("rng"), F.lit(True).alias("guest"))), lambda x: x["rng"].isNotNull())
    dealt = dealt.select(F.explode(places).alias("p"), "key", "doc_id", "text").select("p.rng", "p.guest", "key", "doc_id", "text")
    ordered = dealt.repartition(parts, "rng").sortWithinPartitions("rng", "guest", F.col("key").desc(), F.col("text").asc_nulls_first())
    return ordered.select("rng", "guest", "doc_id", "text").mapInArrow(lean(_compare), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
