"""Shared pieces of the training-data operators: scratch tables, text hashing, Arrow helpers."""

from __future__ import annotations

import atexit
import ctypes
import hashlib
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows taken from an Arrow batch at a time, and the text bytes that end such a slice earlier.
SLICE_ROWS, SLICE_BYTES = 1024, 4 << 20
#: Stashed tables: their session, folder, and a weak reference to the plan's file listing.
_TABLES: list[tuple[SparkSession, str, object]] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; a local one only where that is unset and all tasks
    run in this process (tests)."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not hasattr(scratch_root, "own"):
            scratch_root.own = "file://" + tempfile.mkdtemp(prefix="perkline-")
        root = scratch_root.own
    return root.rstrip("/")


#: Rows and bytes of an Arrow batch between Spark and its Python workers: documents may be long.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def trim() -> None:
    """Give memory that a Python worker no longer uses back to the system: idle workers stay for a while."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: What operators keep in a Python worker between tasks: name -> how to forget it.
CACHES: dict[str, Callable[[], None]] = {}


def _forget(but: str | None) -> None:
    """Workers go from operator to operator; only the one at work keeps what it remembers."""
    for name, clear in CACHES.items():
        if name != but:
            clear()


def lean(run: Callable, cache: str | None = None) -> Callable:
    """`run` over Arrow batches, its memory given back when the task ends, but for the named cache."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget(cache)
        yield from run(batches)
        trim()

    return inner


def lean_group(run: Callable) -> Callable:
    """The same for a function of a group's table."""

    def inner(table: pa.Table) -> pa.Table:
        _forget(None)
        out = run(table)
        trim()
        return out

    return inner


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per context: they need no copy of their own; and
    keep the batches that these get small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    sc = spark.sparkContext
    if getattr(sc, "_perkline_shipped", False):
        return
    top = Path(__file__).resolve().parents[2]
    path = Path(tempfile.mkdtemp(prefix="perkline-")) / "perkline-llm.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("perkline/__init__.py", "")
        for f in sorted(Path(__file__).parent.glob("*.py")):
            z.write(f, str(f.relative_to(top)))
    sc.addPyFile(str(path))
    sc._perkline_shipped = True


def stash(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet to the shared scratch folder and return a frame over the files: lineage ends here,
    so a lost executor costs a re-read and not a re-run of what came before. The files go when no frame reads them."""
    spark = df.sparkSession
    sweep()
    path = f"{scratch_root(spark)}/perkline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    listing = out._jdf.queryExecution().analyzed().relation().location()
    _TABLES.append((spark, path, spark._jvm.java.lang.ref.WeakReference(listing)))
    out._scratch = path
    return out


def sweep() -> None:
    """Delete the stashed tables that no plan refers to any more (every frame over a table shares its file listing)."""
    for x in list(_TABLES):
        try:
            if x[2].refersTo(None):
                _remove(x[0], x[1])
                _TABLES.remove(x)
        except Exception:  # a session that has ended
            _TABLES.remove(x)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def cols_of(names: list[str]) -> list:
    """Columns by their names, whatever these hold."""
    return [F.col(quoted(c)) for c in names]


def replaced(df: DataFrame, **new: Column) -> DataFrame:
    """`df` with some of its columns computed anew, whatever the names of the others hold."""
    return df.select(*[new[c].alias(c) if c in new else F.col(quoted(c)) for c in df.columns])


#: Plans through which a row of a file stays one row.
_PLAIN = ("Project", "Filter", "SubqueryAlias", "LogicalRelation")


def _row_places(df: DataFrame) -> tuple | None:
    """(file, place in it) of the rows of a frame that comes straight from Parquet files; else None."""
    plan = df._jdf.queryExecution().analyzed()
    while True:
        kind = plan.getClass().getSimpleName()
        if kind not in _PLAIN:
            return None
        if kind == "LogicalRelation":
            break
        plan = plan.children().head()
    try:
        meta = df.metadataColumn("_metadata")
        df.select(meta["file_path"], meta["row_index"])
    except AnalysisException:  # files of another kind
        return None
    return meta["file_path"], meta["row_index"]


def keyed(df: DataFrame) -> tuple[DataFrame, str]:
    """`df` with a number for each row, and the name of that column: ids may be null or repeat, rows do not.

    Rows of Parquet files are numbered by a hash of their file's name over their place in it, which is the same in every
    scan; a seed is chosen for which no two files share a hash. Other frames are stashed with numbers."""
    row = fresh(df, "_row")
    places = _row_places(df)
    if not places:
        return stash(df.withColumn(row, F.monotonically_increasing_id())), row
    file, place = places
    files = stash(df.select(file.alias("f"), place.alias("i")).groupBy("f").agg(F.max("i").alias("i")))
    n, top = files.agg(F.count("*"), F.max("i")).first()
    bits = max(1, int(top or 0).bit_length())
    wide = min(63 - bits, 2 * n.bit_length() + 8)
    head = lambda f, seed: F.xxhash64(f, F.lit(seed)).bitwiseAND((1 << wide) - 1)
    seed = 0
    while files.select(F.count_distinct(head(F.col("f"), seed))).first()[0] < n:
        seed += 1
    return df.select("*", F.shiftleft(head(file, seed), bits).bitwiseOR(place).alias(row)), row


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def fresh(df: DataFrame, name: str) -> str:
    """`name`, or that with underscores behind it, so that it clashes with no column of `df`."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


#: Rows (and items of arrays in them) up to which a table of ids and little else may be broadcast: about 10 MB.
SMALL_ROWS = 300_000


def small_side(df: DataFrame, items: Column | None = None) -> DataFrame:
    """`df`, stashed, and marked for broadcast if its rows, and the items that `items` counts in each, were counted to
    be SMALL_ROWS at most; else joined by shuffle."""
    kept = stash(df)
    n = kept.agg(F.count("*") + F.coalesce(F.sum(items if items is not None else F.lit(0)), F.lit(0))).first()[0]
    return F.broadcast(kept) if n <= SMALL_ROWS else kept


#: A key is heavy if it has more than this share of all rows, and so many rows; so there are at most 4096 of them.
HEAVY_SHARE, HEAVY_ROWS = 1 / 4096, 1000


def join_heavy(rows: DataFrame, facts: DataFrame, on: list[str], weight: str, how: str = "inner") -> DataFrame:
    """`rows` with the columns of `facts`, which has one row for each key, `weight` being the key's number of rows.

    Heavy keys, which are few whatever the data, are broadcast, so their rows stay where they are; only the others meet
    in a shuffle. Both sides are read twice: they should be stashed. Keys must not be null."""
    total = facts.agg(F.sum(weight)).first()[0] or 0
    least = max(HEAVY_ROWS, int(total * HEAVY_SHARE))
    heavy = facts.where(F.col(weight) > least).drop(weight)
    if heavy.isEmpty():
        return rows.join(facts.drop(weight), on, how)
    heavy = F.broadcast(stash(heavy))
    rest = rows.join(F.broadcast(heavy.select(*on)), on, "left_anti")
    return rows.join(heavy, on).unionByName(rest.join(facts.where(F.col(weight) <= least).drop(weight), on, how))


def drop_stash(df: DataFrame) -> None:
    """Delete a stashed table that nothing lazy reads any more."""
    path = getattr(df, "_scratch", None)
    if path:
        _remove(df.sparkSession, path)
        _TABLES[:] = [x for x in _TABLES if x[1] != path]


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner find shuffles whose frames are gone, so that their files do not add up over the phases."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


@atexit.register
def _drop_all() -> None:
    for spark, path, _ in _TABLES:
        try:
            if spark.sparkContext._jsc is not None:
                _remove(spark, path)
        except Exception:  # the JVM may be gone already
            pass


def slices(batches: Iterator[pa.RecordBatch], text: int | None = None, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that a slice has few rows and, by column `text`, few bytes (one long row stands alone)."""
    for b in batches:
        if text is None:
            for i in range(0, b.num_rows, rows):
                yield b.slice(i, rows)
            continue
        sizes = np.nan_to_num(np.asarray(pc.binary_length(b.column(text)).to_numpy(zero_copy_only=False), float))
        i = 0
        while i < b.num_rows:
            total, j = 0.0, i
            while j < b.num_rows and j - i < rows and (j == i or total + sizes[j] <= size):
                total += sizes[j]
                j += 1
            yield b.slice(i, j - i)
            i = j


class WordHashes(dict):
    """word bytes -> unsigned 64-bit hash, remembered up to a fixed number of words."""

    LIMIT = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def ascii_words(text: str | None) -> list[bytes]:
    """A-Z lower-cased; maximal runs of anything but U+0020 and U+0009..U+000D (what bytes.split() splits at)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


_A, _B, _S = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33)


def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3: spreads every input bit over the result."""
    x = x ^ (x >> _S)
    x = x * _A
    x = x ^ (x >> _S)
    x = x * _B
    return x ^ (x >> _S)


_M = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k word hashes, in order; empty where there are fewer words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = words[:n].copy()
    for i in range(1, k):
        h = h * _M + words[i : n + i]
    return mix64(h + np.uint64(k))


def shingle_set(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct k-word shingles; a shorter text is one shingle, a text without words none."""
    if not len(words):
        return words
    return np.unique(gram_hashes(words, min(k, len(words))))


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
