"""SentencePiece encoding and decoding with the Tokenizers library as backend.

The model's protobuf is parsed here; from it are rebuilt the normaliser (the character map, read out of its double-array
trie and applied by longest match; dummy prefix; metaspace marker for spaces), the pieces with their scores and types,
byte fallback, and the model itself: a unigram model takes the scores as they are; a BPE model takes as merges every
split of a piece into two pieces, ranked by score. For BPE, texts are cut before each word's metaspace marker, which
changes nothing as no piece holds a marker behind another character and each text begins with one (checked when the
model is read; otherwise texts stay whole, as they do for unigram models, whose sums run over the text). Words are
encoded once and remembered; new ones go to the backend in one multithreaded batch. Parity with the sentencepiece
library is checked on every text whose crc32 of the id is divisible by `verify_every` (1: all).

Defined results: null and empty texts have no pieces and decode to ""; repeated rows and ties give equal results; very
long texts are encoded whole, by words; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perkline.llm.common import CACHES, lean, slices

MARK = "▁"
# Piece types and model types of the protobuf.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (b[i] & 127) << shift
        shift += 7
        i += 1
        if b[i - 1] < 128:
            return value, i


def proto_fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) in order: ints for varints, bytes for the rest."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        wire = key & 7
        if wire == 0:
            value, i = _varint(b, i)
        else:
            if wire == 2:
                n, i = _varint(b, i)
            else:
                n = {1: 8, 5: 4}[wire]
            value, i = b[i : i + n], i + n
        yield key >> 3, value


def read_charsmap(blob: bytes) -> dict[str, str]:
    """What a normaliser's character map replaces, and by what. The blob holds the size of a double-array trie over the
    UTF-8 of the left sides, its 32-bit units, and the right sides, each ended by a zero byte.

    A unit says: bits 0-7 and 31 its label, bit 8 whether a leaf hangs at its own offset, bits 10-30 the offset (times
    256 with bit 9); a leaf's bits 0-30 are the place of its right side."""
    if not blob:
        return {}
    size = struct.unpack("<I", blob[:4])[0]
    units, texts = np.frombuffer(blob, "<u4", size // 4, 4).astype(np.int64), blob[4 + size :]
    child = np.arange(256)
    out, todo = {}, [(b"", 0)]
    while todo:
        key, at = todo.pop()
        unit = int(units[at])
        base = at ^ (unit >> 10 << (unit >> 6 & 8))
        if unit >> 8 & 1 and key:
            place = int(units[base]) & 0x7FFFFFFF
            out[key.decode()] = texts[place : texts.index(b"\0", place)].decode()
        spots = base ^ child
        here = spots < len(units)
        labels = units[np.where(here, spots, 0)] & 0x800000FF
        todo += [(key + bytes([c]), int(spots[c])) for c in np.flatnonzero(here & (labels == child)).tolist() if c]
    return out


class Rewriter:
    """Replaces the longest left side of a table at each place of a text, from the left."""

    def __init__(self, table: dict[str, str], keep: list[str]):
        """keep: strings that stay as they are, before anything else."""
        self.sides: dict[str, list[tuple[str, str]]] = {}
        for own, pairs in ((True, [(k, k) for k in keep if k]), (False, table.items())):
            for k, v in sorted(pairs, key=lambda x: -len(x[0])):
                self.sides.setdefault(k[0], []).append((k, v))
        self.first = re.compile("[" + re.escape("".join(sorted(self.sides))) + "]") if self.sides else None

    def __call__(self, text: str) -> str:
        if not self.first:
            return text
        out, at = [], 0
        while m := self.first.search(text, at):
            i = m.start()
            out.append(text[at:i])
            k, v = next(((k, v) for k, v in self.sides[text[i]] if text.startswith(k, i)), (text[i], text[i]))
            out.append(v)
            at = i + len(k)
        return "".join(out) + text[at:]


class PieceModel:
    """What the protobuf says: pieces [(text, score, type)], kind, unknown id, byte fallback, normaliser settings."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.fallback, self.unk = UNIGRAM, False, 0
        self.prefix, self.squeeze, self.spaces, self.charsmap = True, True, True, b""
        for field, value in proto_fields(data):
            if field == 1:
                p = dict(proto_fields(value))
                self.pieces.append((p.get(1, b"").decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
            elif field == 2:
                t = dict(proto_fields(value))
                self.kind, self.fallback = t.get(3, UNIGRAM), bool(t.get(35, 0))
            elif field == 3:
                n = dict(proto_fields(value))
                self.prefix, self.squeeze, self.spaces, self.charsmap = bool(n.get(3, 1)), bool(n.get(4, 1)), bool(n.get(5, 1)), n.get(2, b"")
        if self.kind not in (UNIGRAM, BPE) or not self.spaces:
            raise ValueError("only unigram and BPE models with escaped spaces are supported")
        self.unk = next(i for i, (_, _, t) in enumerate(self.pieces) if t == UNKNOWN)
        self.rewrite = Rewriter(read_charsmap(self.charsmap), [p.replace(MARK, " ") for p, _, t in self.pieces if t == USER])
        self.by_word = self.kind == BPE and self.prefix and not any(MARK in p[1:] and p.strip(MARK) for p, _, t in self.pieces if t in (NORMAL, USER))
        self.bytes = {i: int(p[3:5], 16) for i, (p, _, t) in enumerate(self.pieces) if t == BYTE}

    def normalise(self, text: str) -> str:
        if self.charsmap:
            text = self.rewrite(text)
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        return (MARK if self.prefix and text else "") + text.replace(" ", MARK)

    def backend(self):
        from tokenizers import Tokenizer, models

        if self.kind == UNIGRAM:
            # pieces that no text may match get names that none can hold; unknown characters fall back to bytes later
            best = max(s for _, s, t in self.pieces if t == NORMAL)
            score = lambda p, s, t: len(p.encode()) * best - 0.1 if t == USER else s
            return Tokenizer(models.Unigram([(p if t in (NORMAL, USER) else f"\0{MARK}\0{i}", score(p, s, t)) for i, (p, s, t) in enumerate(self.pieces)], self.unk, False))
        ids = {p: i for i, (p, _, _) in enumerate(self.pieces)}
        usable = {p: s for p, s, t in self.pieces if t in (NORMAL, USER)}
        merges = []
        for p, s in usable.items():
            merges += [(-s, ids[p], ids[p[:i]], p[:i], p[i:]) for i in range(1, len(p)) if p[:i] in usable and p[i:] in usable]
        merges.sort()
        return Tokenizer(models.BPE(vocab=ids, merges=[(a, b) for *_, a, b in merges], unk_token=self.pieces[self.unk][0], byte_fallback=self.fallback, fuse_unk=not self.fallback))


#: A word: its markers and what follows up to the next marker; without markers, the head of a text.
_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class PieceCodec:
    """Encodes and decodes texts with one model; keeps the ids of about REMEMBERED words, twice; sends BATCH words at a
    time to the backend, on THREADS threads."""

    REMEMBERED, BATCH, JOINED, THREADS = 80_000, 8192, 32, 2

    def __init__(self, data: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        os.environ.setdefault("RAYON_NUM_THREADS", str(self.THREADS))
        self.model = PieceModel(data)
        self.tokenizer = self.model.backend()
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.leads = np.array([p.startswith(MARK) for p, _, _ in self.model.pieces])
        self.of_byte = {c: i for i, c in self.model.bytes.items()}
        table = []
        for i, (p, _, t) in enumerate(self.model.pieces):
            table.append(bytes([self.model.bytes[i]]) if t == BYTE else b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN else p.replace(MARK, " ").encode())
        self.table = table

    def plain(self, text: str) -> bool:
        """Whether single spaces alone cut the text into its words; such words come without their marker."""
        m = self.model
        return m.by_word and not m.charsmap and text != "" and text[0] != " " and text[-1] != " " and "  " not in text and MARK not in text

    def words(self, text: str) -> list[str]:
        """The normalised text cut before each word's marker."""
        text = self.model.normalise(text)
        if not self.model.by_word:
            return [text] if text else []
        return _WORD.findall(text)

    def _learn(self, words: list[str]) -> None:
        """Encodes words that are not known yet. Words without a marker get theirs and go JOINED to a string: no piece
        crosses a marker, so the ids fall apart again before each piece that starts with one."""
        plain = [w for w in words if self.model.by_word and w[0] != MARK]
        for i in range(0, len(plain), self.BATCH):
            part = plain[i : i + self.BATCH]
            joined = ["".join([MARK + w for w in part[j : j + self.JOINED]]) for j in range(0, len(part), self.JOINED)]
            ids = np.concatenate([np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)])
            data, at = ids.tobytes(), [*(4 * np.flatnonzero(self.leads[ids])).tolist(), 4 * len(ids)]
            self.known.update(zip(part, [data[x:y] for x, y in zip(at, at[1:], strict=False)], strict=True))
        rest = [w for w in words if not self.model.by_word or w[0] == MARK]
        if self.model.kind == UNIGRAM and self.model.fallback:
            for w, e in zip(rest, self.tokenizer.encode_batch(rest, add_special_tokens=False), strict=True):
                self.known[w] = self._with_bytes(w, e.ids, e.offsets)
            return
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self.known[w] = np.array(e.ids, np.int32).tobytes()

    def _with_bytes(self, text: str, ids: list[int], offsets: list[tuple[int, int]]) -> bytes:
        """Unknown characters as the pieces of their bytes."""
        out: list[int] = []
        for i, (x, y) in zip(ids, offsets, strict=True):
            out += [self.of_byte[c] for c in text[x:y].encode("utf-8", "surrogatepass")] if i == self.model.unk else [i]
        return np.array(out, np.int32).tobytes()

    def _ids_of(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words."""
        ids = list(map(self.known.get, words))
        gaps = [i for i, x in enumerate(ids) if x is None]
        if gaps:
            again = [(words[i], self.before[words[i]]) for i in gaps if words[i] in self.before]
            self.known.update(again)
            self._learn([words[i] for i in gaps if words[i] not in self.before])
            for i in gaps:
                ids[i] = self.known[words[i]]
        return ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.model.by_word:  # whole texts are not remembered
            self.known, self.before = {}, {}
        if len(self.known) > self.REMEMBERED:  # words of the last generation that are met again move up
            self.known, self.before = {}, self.known
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(texts)
        simple = [i for i, t in enumerate(texts) if self.plain(t)]
        if simple:  # cut and made distinct by Arrow: a word becomes a Python string once a call
            cut = pc.split_pattern(pa.array([texts[i] for i in simple], pa.large_string()), " ")
            cut = pa.concat_arrays(cut.chunks) if isinstance(cut, pa.ChunkedArray) else cut
            words, ends = cut.flatten().dictionary_encode(), cut.offsets.to_numpy()
            find = self._ids_of(words.dictionary.to_numpy(zero_copy_only=False).tolist()).__getitem__
            at = words.indices.to_numpy()
            for i, x, y in zip(simple, ends, ends[1:], strict=False):
                out[i] = np.frombuffer(b"".join(map(find, at[x:y].tolist())), np.int32)
        other = {i: self.words(t) for i, t in enumerate(texts) if t and not self.plain(t)}
        distinct = list({w for words in other.values() for w in words})
        ids = dict(zip(distinct, self._ids_of(distinct), strict=True))
        for i, words in other.items():
            out[i] = np.frombuffer(b"".join([ids[w] for w in words]), np.int32)
        return out

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.table.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.model.prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def codec(data: bytes) -> PieceCodec:
    return PieceCodec(data)


@lru_cache(maxsize=2)
def _judge(data: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=data)


CACHES["pieces"] = lambda: (codec.cache_clear(), _judge.cache_clear())


def read_model(spark: SparkSession, path: str = DEFAULT_MODEL) -> bytes:
    """The model's bytes: from a file of the driver, else by Spark's reader. A model file is a few MB at most."""
    if os.path.exists(path):
        with open(path, "rb") as f:
            return f.read()
    return bytes(spark.read.format("binaryFile").load(path).first()["content"])


#: Texts whose ids the sentencepiece library gives at a time, as Python lists.
JUDGED = 32


def _coded(data, verify_every: int, keep: bool):
    """data: a broadcast of the model's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(data.value)
        for b in slices(batches, text=1, rows=256):
            ids, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            coded = c.encode(texts)
            back = [c.decode(x) for x in coded]
            check = [j for j, i in enumerate(ids) if zlib.crc32(str(i).encode()) % verify_every == 0]
            parity: list[bool | None] = [None] * len(ids)
            for at in range(0, len(check), JUDGED):
                some = check[at : at + JUDGED]
                for j, other in zip(some, _judge(data.value).encode([texts[j] for j in some], num_threads=1), strict=True):
                    parity[j] = coded[j].tolist() == other
            cols = [b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(x) for x in coded], pa.int64()), pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in coded])]
            cols += [pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in back]), pa.array([x == y for x, y in zip(back, texts, strict=True)]), pa.array(parity, pa.bool_())]
            names = ["doc_id", "n_chars", "n_pieces", "ids_sha256", "decoded_sha256", "round_trip", "parity"]
            if keep:
                ends = np.concatenate([[0], np.cumsum([len(x) for x in coded])]).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *coded]))))
                names.append("pieces")
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def encode_pieces(docs: DataFrame, model: str = DEFAULT_MODEL, verify_every: int = 1, keep_ids: bool = True, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, n_pieces, ids_sha256 (little-endian int32), decoded_sha256, round_trip (decoding gave the text
    back), parity (with the sentencepiece library; null where unchecked) and, with keep_ids, pieces array<int>."""
    spark = docs.sparkSession
    data = spark.sparkContext.broadcast(read_model(spark, model))
    schema = "doc_id long, n_chars long, n_pieces long, ids_sha256 string, decoded_sha256 string, round_trip boolean, parity boolean" + ", pieces array<int>" * keep_ids
    return docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(lean(_coded(data, verify_every, keep_ids), "pieces"), schema)


def decode_pieces(coded: DataFrame, model: str = DEFAULT_MODEL, doc: str = "doc_id", pieces: str = "pieces") -> DataFrame:
    """doc_id, text of rows with piece ids; null ids decode to ""."""
    spark = coded.sparkSession
    data = spark.sparkContext.broadcast(read_model(spark, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(data.value)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(np.array(x or [], np.int32)) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return coded.select(F.col(doc).cast("long").alias("doc_id"), F.col(pieces).cast("array<int>").alias("pieces")).mapInArrow(lean(run, "pieces"), "doc_id long, text string")
