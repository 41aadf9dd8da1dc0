"""Exact top-k search by columnar branch and bound.

Queries and candidates are packed into blocks of at most BLOCK rows. Each pair of a query block and a candidate block
is one row of work: the blocks meet by an equi-join on block numbers, so no vector pair is ever a Spark row. Within a
pair of blocks the candidates lie in vertical layout (one contiguous array for each dimension). For a query the
dimensions are visited by falling weight, DIMS at a time; after each such block a candidate survives only if its score
so far plus the largest value the remaining dimensions can add (Cauchy-Schwarz on the remaining mass of both vectors)
reaches the k-th best score known of distinct ids; the arrays are compacted to the survivors. All sums are whole numbers,
so results are exact and ties go to the smaller id. The first threshold comes from a small head of the block, scored in full.

Defined results: vectors that are null, empty, hold null or non-finite components, or whose length differs from the
query's are left out (they neither ask nor answer), as are components that 256 takes beyond the range of doubles; a null id is left out; a query's own row (same id, so also a
repeated row of it) is no answer; repeated rows of another id answer once, by their best score; fewer than k candidates give fewer rows; an
empty table gives none. Scores are exact sums of whole numbers of any size; one beyond 64 bits counts, and is given, as the
nearest 64-bit number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perkline.llm.common import lean

BLOCK, DIMS, HEAD, PLACE_BLOCKS = 8192, 16, 512, 8
#: Whole numbers up to these are exact as doubles and as 64-bit integers; sums that could pass them take the next kind.
EXACT, LONG = float(1 << 53), float(1 << 63)


def _pack(group: str):
    """Arrow rows (id, vector, group) -> one row for each group and dimension: packed ids and a vertical matrix of doubles that are whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}

        def flush(key):
            rows = held.pop(key)
            ids = np.array([r[0] for r in rows], np.int64)
            m = np.stack([r[1] for r in rows])
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([np.ascontiguousarray(m.T).tobytes()], pa.binary())], [group, "dim", "ids", "columns"])

        for b in batches:
            ids, groups = b.column(0).to_pylist(), b.column(2).to_pylist()
            for i, v, g in zip(ids, b.column(1).to_pylist(), groups, strict=True):
                key = (g, len(v))
                held.setdefault(key, []).append((i, np.floor(256.0 * np.array(v, np.float64))))
                if len(held[key]) >= BLOCK:
                    yield flush(key)
        for key in list(held):
            yield flush(key)

    return run


def _kth(ids: np.ndarray, values: np.ndarray, k: int, unique: bool) -> float:
    """The k-th best value over distinct ids, each by its best row; without so many ids, minus infinity."""
    if not unique:
        order = np.lexsort((values, ids))
        ids, values = ids[order], values[order]
        values = values[np.append(ids[1:] != ids[:-1], True)] if len(ids) else values
    return np.partition(values, -k)[-k] if len(values) >= k else -np.inf


def search_block(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query id, candidate id, score): the k best of this block for each query. q: rows; c: vertical, dim x n."""
    dim, n = c.shape
    out = []
    most = float(np.abs(q).max()) * float(np.abs(c).max()) * dim if n and len(q) else 0.0
    if most >= EXACT:
        whole = (lambda x: x.astype(np.int64)) if most < LONG else np.vectorize(int, otypes=[object])
        q, c = whole(q), whole(c)
        for row in range(len(q_ids)):
            alive = np.flatnonzero(c_ids != q_ids[row])
            scores = np.array([max(-(1 << 63), min((1 << 63) - 1, int(x))) for x in (q[row] @ c)[alive]], np.int64)
            out += _best(q_ids[row], c_ids[alive], scores, k)
        return out
    head, unique = min(n, HEAD), len(np.unique(c_ids)) == n
    first = q @ c[:, :head]
    sq = c * c
    for row in range(len(q_ids)):
        own = q[row]
        order = np.argsort(-np.abs(own), kind="stable")
        mass = np.sqrt(np.cumsum((own[order] ** 2)[::-1])[::-1])
        others = c_ids[:head] != q_ids[row]
        bar = _kth(c_ids[:head][others], first[row][others], k, unique)
        alive, acc, rest = np.flatnonzero(c_ids != q_ids[row]), np.zeros(n), sq.sum(0)
        acc, rest = acc[alive], rest[alive]
        for at in range(0, dim, DIMS):
            for d in order[at : at + DIMS]:
                col = c[d][alive] if len(alive) < n else c[d]
                acc = acc + own[d] * col
                rest = rest - col * col
            if at + DIMS >= dim:
                break
            if np.isfinite(bar):
                stay = acc + mass[at + DIMS] * np.sqrt(np.maximum(rest, 0)) >= bar - 0.5
                if not stay.all():
                    alive, acc, rest = alive[stay], acc[stay], rest[stay]
            if len(alive) > 4 * k and at:  # scores so far, less what can still be lost, raise the bar
                low = acc - mass[at + DIMS] * np.sqrt(np.maximum(rest, 0))
                bar = max(bar, _kth(c_ids[alive], low, k, unique))
        out += _best(q_ids[row], c_ids[alive], acc, k)
    return out


def _best(query: int, ids: np.ndarray, scores: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """The k best by score, then id; rows that repeat an id count once."""
    got: dict[int, int] = {}
    for j in np.lexsort((ids, ~scores if scores.dtype == np.int64 else -scores)):
        got.setdefault(int(ids[j]), int(scores[j]))
        if len(got) == k:
            break
    return [(int(query), i, s) for i, s in got.items()]


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                q = np.frombuffer(r["q_columns"], np.float64).reshape(r["dim"], -1).T
                c = np.frombuffer(r["columns"], np.float64).reshape(r["dim"], -1)
                got = search_block(np.frombuffer(r["q_ids"], np.int64), q, np.frombuffer(r["ids"], np.int64), c, k)
                yield pa.RecordBatch.from_arrays([pa.array([g[j] for g in got], pa.int64()) for j in range(3)], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score for the queries (ids divisible by `every`) over all rows of `vectors`."""
    vec = F.col(vec_col).cast("array<double>")
    sound = F.col(id_col).isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * 256) < float("inf")))
    rows = vectors.where(sound).select(F.col(id_col).cast("long").alias("id"), vec.alias("v"))
    asks = rows.where(F.col("id") % every == 0)
    n_asks, n_rows = rows.agg(F.count_if(F.col("id") % every == 0), F.count("*")).first()
    n_q = max(1, -(-n_asks // BLOCK))
    packed = "long, dim int, ids binary, columns binary"
    # query blocks: few large rows, dealt by a hash of the id
    q = asks.withColumn("g", F.pmod(F.xxhash64("id"), F.lit(n_q))).repartition(n_q, "g").mapInArrow(lean(_pack("qblock")), f"qblock {packed}")
    q = q.select("qblock", "dim", F.col("ids").alias("q_ids"), F.col("columns").alias("q_columns"))
    # candidate blocks as they come from the scan; each meets every query block
    c = rows.withColumn("g", F.lit(0).cast("long")).mapInArrow(lean(_pack("cblock")), f"cblock {packed}")
    c = c.withColumn("qblock", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_q - 1).cast("long")))).drop("cblock")
    # dealt by salted query block: a block of queries goes to several places, each with some PLACE_BLOCKS of candidates
    salts = max(32, n_rows // (PLACE_BLOCKS * BLOCK))
    c = c.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts)))
    q = q.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    met = c.join(q, ["qblock", "dim", "salt"]).select("dim", "ids", "columns", "q_ids", "q_columns")
    found = met.mapInArrow(lean(_search(k)), "query_id long, vec_id long, score long")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
