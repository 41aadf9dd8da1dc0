"""Language-model scoring by prediction by partial matching (PPM), with a unigram base score beside it.

The model is a byte-context trie of depth ORDER, learned from the training documents of the whole table: one
scan counts all events (a context of ORDER bytes and the byte behind it) and all words, and both counts are reduced by Spark. Every observed context is kept, at
any size of the corpus. Lower depths count a symbol once for each longer context it followed (update exclusion).
Escapes are estimated by method D (each symbol first seen in a context gives half an event to the escape); below a
context, its symbols are excluded from the shorter ones (symbol exclusion); the last resort is uniform over the rest.
The symbols of a context are among those of its shorter ones, so what is left of a shorter context below a longer one is
a total and a number of symbols: escapes need these two for each context, and no table of symbols.

Look-up: the events of depth 3 and more stay distributed, in buckets by the last three bytes of the context, which hold
all that an event needs at these depths; events of depth 2 and less are 256 ** 3 at most and go to every task. Texts are
packed in blocks of about BLOCK bytes; a block asks for each of its distinct events once, buckets answer with log
probabilities in the order asked, and a block adds them up over its texts.
Each text is coded from a start context to an end mark (byte 255, which UTF-8 never has).

Base score: c, N and V over the training tokens. Words that make up FREQUENT of all tokens or more (so at most
1 / FREQUENT of them) are looked up in the scan; the rest meet their counts in a join on the word's 64-bit hash, where
no key can be hot.

Defined results: null text is empty: one token, the end; a null doc_id counts as the empty text for the fold;
repeated rows are scored, and learned from, each on its own; an empty table gives no rows; without training documents
all counts are 0 and V + 1 is 1; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perkline.llm.common import SLICE_ROWS, WordHashes, ascii_words, drop_stash, free_shuffles, lean, slices, stash, trim

ORDER, FREQUENT = 5, 2.0**-18
FOLDS, HELD = 7, 2
PAD, END = b"\xff" * ORDER, b"\xff"
#: The end of a text as a word: no word holds a space.
END_WORD = b" end"
#: Codes that a task gathers before it reduces them; counts of more than FULL distinct ones are passed on, in parts that
#: Spark adds up, so a task's memory does not grow with its rows.
GATHER, FULL = 3_000_000, 2_000_000
#: Bytes of text in a block, and in a slice of it; training events for which there is a bucket.
BLOCK, PIECE, BUCKET_EVENTS = 24 << 20, 1 << 20, 8_000_000


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD


def _events(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes of all events, starts and ends of each text among them); the codes between texts are no events."""
    a = np.frombuffer(b"".join([PAD + t + END for t in texts]), np.uint8)
    code = a[:-ORDER].astype(np.uint64)
    for i in range(1, ORDER + 1):
        code = code << np.uint64(8) | a[i : len(a) - ORDER + i]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    starts = np.concatenate([[0], np.cumsum(sizes + ORDER)[:-1]])
    return code, starts, starts + sizes


def _starts(x: np.ndarray) -> np.ndarray:
    """Where the runs of equal values of a sorted array begin."""
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return np.flatnonzero(new)


def _union(parts: list[np.ndarray]) -> np.ndarray:
    """The distinct codes of all parts, sorted."""
    codes = np.concatenate(parts)
    codes.sort()
    return codes[_starts(codes)]


class _Union:
    """Distinct codes, gathered as arrays and reduced now and then."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, codes: np.ndarray) -> None:
        self.parts.append(codes)
        self.size += len(codes)
        if self.size > GATHER and len(self.parts) > 1:
            whole = self.reduced()
            self.parts, self.size = [whole], min(len(whole), GATHER // 2)

    def reduced(self) -> np.ndarray:
        return _union(self.parts)


class _Tally:
    """Counts of 64-bit codes, gathered as arrays and reduced now and then."""

    def __init__(self):
        self.codes, self.counts, self.size = [], [], 0

    def add(self, codes: np.ndarray, in_order: bool = False) -> None:
        codes = codes if in_order else np.sort(codes)
        starts = _starts(codes)
        c, n = codes[starts], np.diff(np.append(starts, len(codes)))
        self.codes.append(c)
        self.counts.append(n)
        self.size += len(c)
        if self.size > GATHER:
            c, n = self.taken()
            self.codes, self.counts, self.size = [c], [n], len(c)

    @property
    def full(self) -> bool:
        return self.size > FULL and len(self.codes) == 1

    def taken(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct codes, sorted, and their counts; the tally is empty then."""
        codes, counts = self.codes, self.counts
        self.__init__()
        if not codes:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        codes = np.concatenate(codes)
        order = np.argsort(codes)
        codes = codes[order]
        counts = np.concatenate(counts)[order]
        del order
        starts = _starts(codes)
        return codes[starts], np.add.reduceat(counts, starts)


#: Bits for the number of a text in a slice, below its event's code in one 64-bit number.
TEXT_BITS = (SLICE_ROWS - 1).bit_length()


def _tagged(texts: list[bytes]) -> np.ndarray:
    """(code, number of the text) of all events of a slice, packed in one number each, sorted: so the events of a code
    stand together, and all look-ups go through tables in order."""
    code, starts, ends = _events(texts)
    real = np.ones(len(code), bool)
    for e in ends[:-1]:
        real[e : e + ORDER] = False
    return np.sort(code[real] << np.uint64(TEXT_BITS) | np.repeat(np.arange(len(texts), dtype=np.uint64), ends - starts))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, words, grams = WordHashes(), _Tally(), _Tally()
    end = hashes[END_WORD]

    def rows(kind: int, tally: _Tally) -> Iterator[pa.RecordBatch]:
        codes, counts = tally.taken()
        for i in range(0, len(codes), 1 << 17):
            part = codes[i : i + (1 << 17)].astype(np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int8)), pa.array(part), pa.array(counts[i : i + (1 << 17)])], ["kind", "code", "n"])

    for b in slices(batches, text=1, size=PIECE):
        texts = [t or "" for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if not held_out(i)]
        if not texts:
            continue
        words.add(np.concatenate([*(hashes.of(ascii_words(t)) for t in texts), np.full(len(texts), end, np.uint64)]))
        grams.add(_codes(_bytes_of(texts)), True)
        for kind, tally in ((0, words), (1, grams)):
            if tally.full:
                yield from rows(kind, tally)
    yield from rows(0, words)
    yield from rows(1, grams)


def context_table(levels: list[np.ndarray]) -> np.ndarray:
    """Probabilities (rows x 256) from counts (rows x 256) of contexts of falling depth, by escape method D with
    symbol exclusion; what is left after the last level is uniform over the symbols not yet seen."""
    shape = levels[0].shape
    p, weight, seen = np.zeros(shape), np.ones((shape[0], 1)), np.zeros(shape, bool)
    for counts in levels:
        c = np.where(seen, 0, np.broadcast_to(counts, shape)).astype(np.float64)
        n, d = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
        some = n > 0
        whole = np.where(some, 2 * n, 1)
        p += np.where(c > 0, weight * (2 * c - 1) / whole, 0)
        weight = np.where(some, weight * d / whole, weight)
        seen |= c > 0
    rest = 256 - seen.sum(1, keepdims=True)
    return p + np.where(seen, 0, weight / np.maximum(rest, 1))


def _find(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there) of each value in a sorted table; places are valid even where it is not."""
    if not len(table):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return at, table[at] == values


class _Level:
    """The events of one depth, sorted, their counts, their contexts, and each context's total and number of symbols;
    left_n, left_d: what is left of these in the next shorter context without the symbols of this one."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, lower: _Level | None, depth: int):
        order = np.argsort(codes)
        self.events, self.counts, self.mask = codes[order].astype(np.int64), counts[order].astype(np.int64), (1 << 8 * (depth + 1)) - 1
        self.contexts, starts = np.unique(self.events >> 8, return_index=True)
        add = lambda x: np.add.reduceat(x, starts) if len(starts) else np.empty(0, np.int64)
        self.n, self.d = add(self.counts), np.diff(np.append(starts, len(self.events)))
        if lower is not None and len(starts):
            at, up = _find(lower.events, self.events & lower.mask)[0], _find(lower.contexts, self.contexts & (lower.mask >> 8))[0]
            self.left_n, self.left_d = lower.n[up] - add(lower.counts[at]), lower.d[up] - self.d
        else:
            self.left_n = self.left_d = np.zeros(len(starts), np.int64)


def short_levels(two: tuple) -> list[_Level]:
    """The levels of depth 2, 1 and 0 from (codes, counts) of all events behind two bytes."""
    c2, n2 = np.unique(two[0] & 0xFFFF, return_counts=True)
    zero = _Level(*np.unique(c2 & 0xFF, return_counts=True), None, 0)
    one = _Level(c2, n2, zero, 1)
    return [_Level(*two, one, 2), one, zero]


class PpmModel:
    """The counts of a set of events of full depth, with all those of the depths down to 3, and the short levels."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, low: list[_Level]):
        """codes, counts: the events behind contexts of ORDER bytes; low: the levels of depth 2, 1 and 0."""
        events = [(codes, counts)]
        for depth in range(ORDER - 1, 2, -1):
            events.append(np.unique(events[-1][0] & (1 << 8 * (depth + 1)) - 1, return_counts=True))
        self.levels = low
        for depth, (c, n) in zip(range(3, ORDER + 1), reversed(events), strict=True):
            self.levels = [_Level(c, n, self.levels[0], depth), *self.levels]

    def logs(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of each event, by escape method D with symbol exclusion."""
        codes = codes.astype(np.int64)
        p, weight, out = np.ones(len(codes)), np.ones(len(codes)), np.zeros(len(codes), bool)
        left_n = left_d = np.zeros(len(codes), np.int64)
        longer = np.zeros(len(codes), bool)
        for level in self.levels:
            event = codes & level.mask
            at, there = _find(level.contexts, event >> 8)
            place, hit = _find(level.events, event)
            if len(level.contexts):
                n, d = np.where(longer, left_n, level.n[at]), np.where(longer, left_d, level.d[at])
                whole = np.where(there & (n > 0), 2.0 * n, 1.0)
                new = hit & ~out
                p = np.where(new, weight * (2.0 * level.counts[place] - 1) / whole, p)
                out |= hit
                weight = np.where(there & (n > 0), weight * d / whole, weight)
                left_n, left_d = level.left_n[at], level.left_d[at]
            longer = there
        rest = max(1, 256 - len(self.levels[-1].events))
        return np.log10(np.where(out, p, weight / rest))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text with its end."""
        code, starts, ends = _events(texts)
        return _sums(self.logs(code), starts, ends)


def _sums(each: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    bounds = np.stack([starts, np.minimum(ends, len(each))], 1).ravel()
    return np.add.reduceat(np.append(each.astype(np.float64), 0.0), bounds)[::2]


#: A bucket is some bits of the last three context bytes times this number, in Spark and in numpy alike.
SPREAD = 2654435761


def _buckets(codes: np.ndarray, buckets: int) -> np.ndarray:
    return ((codes.astype(np.int64) >> 8 & 0xFFFFFF) * SPREAD >> 12 & 0xFFFFF) % buckets


def _bytes_of(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def _asked(events: _Union, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct events, the order in which they are asked for, their buckets in this order)."""
    codes = events.reduced()
    where = _buckets(codes, buckets)
    order = np.argsort(where, kind="stable")
    return codes, order, where[order]


def _codes(texts: list[bytes]) -> np.ndarray:
    """The codes of all events of a slice, sorted."""
    return _tagged(texts) >> np.uint64(TEXT_BITS)


def _distinct(batch: pa.RecordBatch) -> np.ndarray:
    codes = _codes(_bytes_of(batch.column(1).to_pylist()))
    return codes[_starts(codes)]


def _ask(buckets: int):
    """(doc_id, text) -> rows of (block, bucket, data): bucket -1 has packed texts, the others the events asked for."""
    def rows(block, where, data):
        return pa.RecordBatch.from_arrays([pa.array([block] * len(data), pa.int64()), pa.array(where, pa.int32()), pa.array(data, pa.binary())], ["block", "bucket", "data"])

    def flush(block, held):
        codes, order, where = _asked(held, buckets)
        cuts = np.flatnonzero(np.diff(where)) + 1
        parts = np.split(codes[order], cuts)
        return rows(block, where[np.append(0, cuts)], [np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : ORDER + 1].T).tobytes() for x in parts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        how = pa.ipc.IpcWriteOptions(compression="zstd")
        block, size, held = TaskContext.get().partitionId() << 32, 0, _Union()
        for b in slices(batches, text=1, size=PIECE):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema, options=how) as w:
                w.write_batch(b)
            yield rows(block, [-1], [sink.getvalue().to_pybytes()])
            held.add(_distinct(b))
            size += (pc.sum(pc.binary_length(b.column(1))).as_py() or 0) + b.num_rows
            if size > BLOCK:
                yield flush(block, held)
                block, size, held = block + 1, 0, _Union()
        if held.parts:
            yield flush(block, held)

    return run


def _answer(low):
    """low: broadcast of the short levels. (events of a bucket with counts, what blocks ask of it) -> log probabilities."""

    def run(events: pa.Table, asks: pa.Table) -> pa.Table:
        model = PpmModel(events.column("code").to_numpy(), events.column("n").to_numpy(), low.value) if asks.num_rows else None
        logs = []
        for x in asks.column("data").to_pylist():
            codes = np.zeros((len(x) // (ORDER + 1), 8), np.uint8)
            codes[:, : ORDER + 1] = np.frombuffer(x, np.uint8).reshape(ORDER + 1, -1).T
            logs.append(model.logs(codes.view("<i8").ravel()).astype(np.float32).tobytes())
        out = pa.table([asks.column("block"), asks.column("bucket"), pa.array(logs, pa.binary())], ["block", "bucket", "logs"])
        trim()
        return out

    return run


class _WordNumbers(dict):
    """word -> a number in order of first sight, and the words' hashes by these numbers; for a limited number of words."""

    def __init__(self):
        self.hashes = WordHashes()
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.of = []

    def __missing__(self, word: bytes) -> int:
        self.of.append(self.hashes[word])
        n = self[word] = len(self.of) - 1
        return n


def _score(data, buckets: int):
    """data: broadcast of (frequent hashes sorted, their counts). (packed texts of a block, answers to it) -> rows."""
    rare_type = pa.struct([("h", pa.int64()), ("m", pa.int32())])

    def run(packed: pa.Table, answers: pa.Table) -> pa.Table:
        known, counts = data.value
        logs, numbers = np.log10(counts + 1.0), _WordNumbers()
        read = lambda: (pa.ipc.open_stream(x).read_next_batch() for x in packed.column("data").to_pylist())
        asked = _Union()
        for b in read():
            asked.add(_distinct(b))
        events, order, _ = _asked(asked, buckets)
        del asked
        told = answers.sort_by("bucket").column("logs").to_pylist()
        likely = np.empty(len(events), np.float32)
        likely[order] = np.frombuffer(b"".join(told), np.float32)
        done = []
        for b in read():
            ids, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            tagged = _tagged(_bytes_of(texts))
            code = tagged >> np.uint64(TEXT_BITS)
            starts = _starts(code)
            each = np.repeat(likely[np.searchsorted(events, code[starts])].astype(np.float64), np.diff(np.append(starts, len(code))))
            score = np.bincount((tagged & np.uint64(SLICE_ROWS - 1)).astype(np.int64), each, len(texts))
            # words: runs of (text, number of the word)
            cut = [[*ascii_words(t), END_WORD] for t in texts]
            if len(numbers) > WordHashes.LIMIT:
                numbers.clear()
            total = np.fromiter(map(len, cut), np.int64, len(cut))
            word = np.fromiter((n for w in cut for n in map(numbers.__getitem__, w)), np.int64, int(total.sum()))
            word = np.sort(np.repeat(np.arange(len(cut)) << 32, total) | word)
            starts = _starts(word)
            text, word, m = word[starts] >> 32, word[starts] & 0xFFFFFFFF, np.diff(np.append(starts, len(word)))
            hashes = np.array(numbers.of, np.uint64)
            at, hit = _find(known, hashes)
            gain = np.where(hit, logs[at], 0.0) if len(logs) else np.zeros(len(hashes))
            some = ~hit[word]
            stops = np.append(0, np.cumsum(np.bincount(text[some], minlength=len(texts))))
            rare = pa.StructArray.from_arrays([pa.array(hashes[word[some]].view(np.int64)), pa.array(m[some].astype(np.int32))], fields=list(rare_type))
            out = [b.column(0), pa.array([held_out(i) for i in ids]), pa.array(total), pa.array(np.bincount(text, gain[word] * m, len(texts))), pa.array(np.bincount(text, hit[word] * m, len(texts)).astype(np.int64))]
            out += [pa.array(score), pa.ListArray.from_arrays(pa.array(stops.astype(np.int32)), rare)]
            done.append(pa.RecordBatch.from_arrays(out, ["doc_id", "held_out", "n_tokens", "sum_known", "n_found", "score", "rare"]))
        trim()
        return pa.Table.from_batches(done)

    return run


def score_documents(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per document."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    counted = stash(rows.mapInArrow(lean(_count), "kind byte, code long, n long").groupBy("kind", "code").agg(F.sum("n").alias("n")))
    words, grams = counted.where("kind = 0").select("code", "n"), counted.where("kind = 1").select("code", "n")
    n_all, vocabulary, n_events = counted.agg(F.sum(F.when(F.col("kind") == 0, F.col("n"))), F.count(F.when(F.col("kind") == 0, 1)), F.sum(F.when(F.col("kind") == 1, F.col("n")))).first()
    n_all, n_events = n_all or 0, n_events or 0
    # at most 256 ** 3 three-byte codes; at most 1 / FREQUENT words
    short = grams.select(F.col("code").bitwiseAND(0xFFFFFFFF).alias("code")).distinct()
    two = short.groupBy(F.col("code").bitwiseAND(0xFFFFFF).alias("code")).agg(F.count("*").alias("n")).toPandas()
    low = spark.sparkContext.broadcast(short_levels((two["code"].to_numpy(np.int64), two["n"].to_numpy(np.int64))))
    often = words.where(F.col("n") >= n_all * FREQUENT).toPandas()
    known = often["code"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(known)
    data = spark.sparkContext.broadcast((known[order], often["n"].to_numpy(np.int64)[order]))
    free_shuffles(spark)
    buckets = 1 << max(6, (n_events // BUCKET_EVENTS).bit_length())
    asked = stash(rows.mapInArrow(lean(_ask(buckets)), "block long, bucket int, data binary"))
    place = F.pmod(F.shiftright(F.shiftright("code", 8).bitwiseAND(0xFFFFFF) * F.lit(SPREAD), 12).bitwiseAND(0xFFFFF), F.lit(buckets)).cast("int")
    events = grams.select(place.alias("bucket"), "code", "n").groupBy("bucket")
    answers = events.cogroup(asked.where("bucket >= 0").groupBy("bucket")).applyInArrow(_answer(low), "block long, bucket int, logs binary")
    texts = asked.where("bucket < 0").groupBy("block")
    scored = texts.cogroup(answers.groupBy("block")).applyInArrow(_score(data, buckets), "doc_id long, held_out boolean, n_tokens long, sum_known double, n_found long, score double, rare array<struct<h:long,m:int>>")
    scored = stash(scored.withColumn("row", F.monotonically_increasing_id()))
    drop_stash(asked)
    free_shuffles(spark)
    met = scored.select("row", F.explode("rare").alias("r")).select("row", F.col("r.h").alias("code"), F.col("r.m").alias("m")).join(words.where(F.col("n") < n_all * FREQUENT), "code")
    late = met.groupBy("row").agg(F.sum(F.col("m") * F.log10(F.col("n") + 1.0)).alias("s"), F.sum("m").cast("long").alias("k"))
    out = scored.drop("rare").join(late, "row", "left")
    base = F.col("sum_known") + F.coalesce("s", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(n_all + vocabulary + 1)))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_found") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
