"""Secret scans with corpus-wide ownership frequency.

One pass over whole texts finds the spans of the fixed kinds (assign, access, hex) and further candidates: long mixed
strings outside those spans. Each distinct value is then counted over the corpus by distinct repositories and distinct
owners, from its hash alone. A value in several repositories and with several owners is a widely copied example: neither many
repositories of one owner nor one repository that several owners hold (a mirror) make it one. Any other value that
looks live (enough entropy, no placeholder) belongs to its owner. Candidates of that sort become spans of kind `owned`; the
fixed spans stay whatever their class, but are counted as live or example.

Counting: (hash, owner, repository) is reduced before the distinct counts, each with map-side combine, so a value in a
third of all rows is a few rows per task; the counts of such values come back to their rows by broadcast.

Defined results: null text is empty and has no spans; null owner or repository counts as the one named ""; a repeated
row is the same repository of the same owner; very long texts are scanned whole; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from perkline.llm.common import cols_of, fresh, join_heavy, keyed, lean, quoted, replaced, slices, small_side, stash

# Kinds in their order, and their patterns.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
# The method's own kind.
OWNED = "owned"
MIXED = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
PLACEHOLDER = re.compile(r"x{4,}|0{6,}|1234567|example|changeme|placeholder|your[_-]", re.I)
#: From so many distinct owners and repositories on, a value is a copied example.
EXAMPLE_OWNERS, EXAMPLE_REPOS = 2, 2
#: A live value has so many bits a character at least.
LIVE_BITS = 3.0

SPAN = "struct<kind:string,start:int,end:int,hash:long,base:boolean,live:boolean>"


def entropy(value: str) -> float:
    """Bits a character under the value's own frequencies."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def looks_live(value: str) -> bool:
    return entropy(value) >= LIVE_BITS and not PLACEHOLDER.search(value)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, order of kind, end, value) of the fixed kinds, in order of start, then kind."""
    out = []
    low = text.lower() if ("=" in text or ":" in text) else ""
    if low and any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, taken: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str]]:
    """Long mixed strings (letters of both cases and digits) that touch no fixed span."""
    out, i = [], 0
    by_start = sorted((s, e) for s, _, e, _ in taken)
    for m in MIXED.finditer(text):
        v = m[0]
        while i < len(by_start) and by_start[i][1] <= m.start():
            i += 1
        j, clash = i, False
        while j < len(by_start) and by_start[j][0] < m.end() and not clash:
            clash, j = by_start[j][1] > m.start(), j + 1
        if not clash and any(c.isdigit() for c in v) and v.lower() != v and v.upper() != v and looks_live(v):
            out.append((m.start(), m.end(), v))
    return out


def _digest(value: str) -> int:
    return int.from_bytes(xxhash.xxh64_digest(value.encode("utf-8", "surrogatepass")), "big", signed=True)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("hash", pa.int64()), ("base", pa.bool_()), ("live", pa.bool_())]))
    for b in slices(batches, text=3):
        counts, hashes, spans = [[], [], []], [], []
        for text in b.column(3).to_pylist():
            text = text or ""
            base = base_spans(text)
            kinds = Counter(k for _, k, _, _ in base)
            for k in range(3):
                counts[k].append(kinds[k])
            hashes.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in base).encode()).hexdigest())
            spans.append(
                [{"kind": KINDS[k], "start": s, "end": e, "hash": _digest(v), "base": True, "live": looks_live(v)} for s, k, e, v in base]
                + [{"kind": OWNED, "start": s, "end": e, "hash": _digest(v), "base": False, "live": True} for s, e, v in candidates(text, base)]
            )
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *(pa.array(c, pa.int64()) for c in counts), pa.array(hashes, pa.string()), pa.array(spans, kind)], ["doc_id", "repo", "owner", "n_assign", "n_access", "n_hex", "base_sha256", "found"])


def scan_secrets(docs: DataFrame, doc: str = "doc_id", text: str = "text", owner: str = "source", repo: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, found.

    `owner` names the column of owners. `repo` names the column of repositories; without one, each document is a
    repository of its own. found: array of struct(kind, start, end, owners, repos, owned), the spans as data."""
    own = F.coalesce(F.col(owner).cast("string"), F.lit(""))
    rep = F.coalesce(F.col(repo if repo else doc).cast("string"), F.lit(""))
    scanned = docs.select(F.col(doc).cast("long").alias("doc_id"), rep.alias("repo"), own.alias("owner"), F.col(text).cast("string").alias("text"))
    scanned = stash(scanned.mapInArrow(lean(_scan), f"doc_id long, repo string, owner string, n_assign long, n_access long, n_hex long, base_sha256 string, found array<{SPAN}>").withColumn("row", F.monotonically_increasing_id()))
    held = scanned.select("row", "owner", "repo", F.explode("found").alias("f")).select("row", "owner", "repo", "f.*")
    seen = held.groupBy("hash", "owner", "repo").agg(F.count("*").alias("rows"))
    spread = stash(seen.groupBy("hash").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repo").alias("repos"), F.sum("rows").alias("rows")))
    copied = (F.col("owners") >= EXAMPLE_OWNERS) & (F.col("repos") >= EXAMPLE_REPOS)
    told = join_heavy(held, spread, ["hash"], "rows").withColumn("copied", copied).withColumn("owned", ~F.col("copied") & F.col("live"))
    told = told.where(F.col("base") | F.col("owned"))
    rank = F.when(F.col("kind") == KINDS[0], 0).when(F.col("kind") == KINDS[1], 1).when(F.col("kind") == KINDS[2], 2).otherwise(3)
    told = told.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "end", "kind", "owners", "repos", "owned", "copied"))).alias("s"))
    out = scanned.drop("found").join(told, "row", "left").withColumn("s", F.coalesce("s", F.array().cast(told.schema["s"].dataType)))
    joined = F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda f: F.size(F.filter("s", f)).cast("long")
    found = F.transform("s", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["owners"].alias("owners"), x["repos"].alias("repos"), x["owned"].alias("owned")))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", joined.alias("spans"), count(lambda x: x["owned"]).alias("n_live"), count(lambda x: x["copied"]).alias("n_example"), found.alias("found"))


def _redact(text: int, mark: str):
    """Replaces the spans in the last column (start, end pairs) of each row's text; column `text` is the text's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text=text):
            *cols, cuts = b.columns
            out = []
            for t, s in zip(cols[text].to_pylist(), cuts.to_pylist(), strict=True):
                if t and s:
                    parts, at = [], 0
                    for x in sorted((x["start"], x["end"]) for x in s):
                        if x[0] >= at:
                            parts += [t[at : x[0]], mark]
                        at = max(at, x[1])
                    t = "".join(parts) + t[at:]
                out.append(t)
            cols[text] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(cols, b.schema.names[:-1])

    return run


def redact_secrets(docs: DataFrame, mark: str = "[secret]", doc: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """`docs` with every span that is live, or of a fixed kind, replaced by `mark`; all rows and columns stay, and
    `n_chars` follows the text where there is such a column. Each row is cut at its own spans, whatever its id."""
    rows, row = keyed(docs)
    key, cuts = fresh(rows, "_key"), fresh(rows, "_cuts")
    found = scan_secrets(rows, doc=row, text=text, **{"repo": doc} | how).where(F.size("found") > 0)
    found = found.select(F.col("doc_id").alias(key), F.transform("found", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias(cuts))
    found = small_side(found, F.size(cuts))
    both = rows.join(found, F.col(row) == F.col(key), "left").select(*cols_of([*docs.columns, cuts]))
    # plain names on the way through Python
    names = [f"c{i}" for i in range(len(docs.columns))]
    kinds = StructType([StructField(n, f.dataType) for n, f in zip(names, docs.schema, strict=True)])
    out = both.toDF(*names, "cuts").mapInArrow(lean(_redact(docs.columns.index(text), mark)), kinds).toDF(*docs.columns)
    return replaced(out, n_chars=F.length(F.col(quoted(text))).cast("long")) if "n_chars" in docs.columns else out
