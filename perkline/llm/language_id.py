"""Language ID by Bayesian evidence fusion.

log P(L | row) = tempered text likelihood + declared language + prior of the host, up to a constant:

* text: byte-trigram naive Bayes, trigrams hashed into BINS; fitted on a bounded sample (SAMPLE rows, chosen by a hash
  of the id) of rows that carry a label. A further hypothesis `und` spreads its mass evenly over the bins: text that
  fits no language better than that, or that has no trigram, is rejected. Likelihoods count at most TEMPER trigrams'
  worth of evidence, as neighbouring trigrams are not independent.
* declared: P(declared | L), from counts of declared codes against text evidence, smoothed. For plain documents a label
  of the table may stand for it (the text model's sample is labelled by it too).
* host: P(L | host) from grouped sums of text evidence over all rows, smoothed towards the address suffix, and that
  towards all rows (each level weighs as STRENGTH rows).

What a row adds to these counts itself is taken out of them before they speak about it, so no row is its own witness.

All counts are sums over all rows with map-side combine; hosts with a large share of all rows get their sums by
broadcast, the others in a shuffle. Pages are cleaned in linear time, whatever tags they leave open. Defined results: null or empty text, or text too short for a trigram: lang `und`, rejected; null html,
address, host or declared code: no such evidence; repeated rows count each; ties go to the language first in order; an
empty table gives no rows; columns other than those named are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perkline.llm.common import join_heavy, lean, slices, small_side, stash

BINS, SAMPLE, TEMPER, STRENGTH, PIECE = 1 << 15, 4000, 400, 20.0, 1 << 20
#: Prior odds of `und`, and how much worse than even a language may fit before it loses to `und` (nats a trigram).
UND_PRIOR, UND_SLACK = 1e-4, 0.0
_K = np.uint32(2654435761)
_OPENER = re.compile(r"(?i)<(script|style)\b|<!--")
_CLOSERS = {"script": re.compile(r"(?i)</script\s*>"), "style": re.compile(r"(?i)</style\s*>"), "": re.compile("-->")}
_TAG = re.compile(r"<[^>]*>")


def visible_text(html: str | None) -> str:
    """Text of a page without scripts, styles, comments and tags, entities resolved. What is not closed stays."""
    if not html:
        return ""
    kept, at, pos, unclosed = [], 0, 0, set()
    while len(unclosed) < len(_CLOSERS) and (m := _OPENER.search(html, pos)):
        kind, pos = (m[1] or "").lower(), m.end()
        end = None if kind in unclosed else _CLOSERS[kind].search(html, pos)
        if end:
            kept.append(html[at : m.start()])
            at = pos = end.end()
        else:  # nor will a later one of this kind be closed
            unclosed.add(kind)
    text = " ".join([*kept, html[at:]])
    last = text.rfind(">") + 1  # behind it, no tag ends
    return html_lib.unescape(_TAG.sub(" ", text[:last]) + text[last:])


def trigram_bins(text: str) -> np.ndarray:
    """Counts of hashed byte trigrams of the lower-cased text, digits as one symbol and space runs as one space."""
    data = re.sub(rb"[\x00-\x20]+", b" ", re.sub(rb"[0-9]", b"0", text.lower().encode("utf-8", "surrogatepass")))
    out = np.zeros(BINS, np.int64)
    for at in range(0, len(data) - 2, PIECE):
        a = np.frombuffer(data, np.uint8)[at : at + PIECE + 2].astype(np.uint32)
        out += np.bincount(((a[:-2] << np.uint32(16) | a[1:-1] << np.uint32(8) | a[2:]) * _K >> np.uint32(17)).view(np.int32), minlength=BINS)
    return out


class TextModel:
    """langs in order; logs: BINS x (languages + und) natural logs."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        p = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * BINS)
        self.logs = np.concatenate([np.log(p).T, np.full((BINS, 1), -np.log(BINS) - UND_SLACK)], 1)

    def evidence(self, text: str) -> np.ndarray | None:
        """Tempered log likelihoods, the best one 0; None for texts without trigrams."""
        bins = trigram_bins(text)
        n = bins.sum()
        if not n:
            return None
        at = np.flatnonzero(bins)
        ll = bins[at] @ self.logs[at] * min(1.0, TEMPER / n)
        return ll - ll.max()


def fit_text_model(labelled: DataFrame, sample: int = SAMPLE, doc: str = "doc_id", lang: str = "lang", text: str = "text") -> TextModel:
    """Fits on about `sample` rows (all, if there are fewer), whole texts."""
    known = labelled.where(F.col(lang).isNotNull() & F.col(doc).isNotNull())
    n = known.count()
    if n > sample:
        known = known.where(F.pmod(F.xxhash64(F.col(doc)), F.lit(1 << 30)) < int((1 << 30) * sample / n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in slices(batches, text=1):
            for code, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums.setdefault(code, np.zeros(BINS, np.int64))
                sums[code] += trigram_bins(t or "")
        for code, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([code] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], ["lang", "bin", "n"])

    counted = known.select(F.lower(F.substring(F.col(lang).cast("string"), 1, 2)).alias("lang"), F.col(text).cast("string").alias("text")).mapInArrow(lean(run), "lang string, bin int, n long")
    got = counted.groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()  # at most BINS rows a language
    langs = sorted(got["lang"].unique())
    counts = np.zeros((len(langs), BINS))
    counts[got["lang"].map({c: i for i, c in enumerate(langs)}).to_numpy(int), got["bin"].to_numpy(int)] = got["n"].to_numpy(float)
    return TextModel(langs, counts)


def _evidence(data):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = data.value
        empty = np.array([0.0] * (len(model.langs) + 1))
        for b in slices(batches, text=0):
            lls, votes, any_text = [], [], []
            for t, markup in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ll = model.evidence(visible_text(t) if markup else t or "")
                any_text.append(ll is not None)
                lls.append(empty if ll is None else ll)
                votes.append(empty if ll is None else np.exp(ll) / np.exp(ll).sum())
            ends = pa.array(np.arange(len(lls) + 1, dtype=np.int32) * len(empty))
            told = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in (lls, votes)]
            yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(any_text), *told], [*b.schema.names[2:], "any_text", "ll", "vote"])

    return run


def _fuse(langs: list[str], total: list[float], with_code: list[float], codes: int):
    """Posteriors from a row's evidence and the sums that concern it, without the row's own share in these."""
    names, k = np.array(langs, object), len(langs)
    whole, coded = np.array(total), np.array(with_code)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, said = b.column(4).to_numpy(zero_copy_only=False).astype(bool), b.column(9)
            ll, vote, suffix, host = (b.column(i).flatten().to_numpy().reshape(-1, k) for i in (5, 6, 7, 8))
            prior = np.full((len(text), k), 1.0 / k)
            for sums, weight in ((np.broadcast_to(whole, vote.shape), float(k)), (suffix, STRENGTH), (host, STRENGTH)):  # all rows -> suffix -> host
                others = np.maximum(sums - vote, 0.0)
                prior = (others + weight * prior) / (np.maximum(sums.sum(1) - text, 0.0)[:, None] + weight)
            post = ll + np.log(prior)
            has = pc.list_value_length(said).to_numpy(zero_copy_only=False) > 0
            if has.any():
                same, own = said.flatten().to_numpy().reshape(-1, k), vote[has]
                post[has] += np.log((np.maximum(same - own, 0.0) + 0.5) / (np.maximum(coded - own, 0.0) + 0.5 * codes))
            post[:, -1] += np.log(UND_PRIOR)
            best = post.argmax(1)
            share = 1.0 / np.exp(post - post.max(1, keepdims=True)).sum(1)
            told = [np.where(text, names[x], "und") for x in (best, ll.argmax(1))]
            cols = [b.column(0), b.column(1), pa.array(told[0], pa.string()), pa.array(np.where(text, share, 0.0)), pa.array(told[1], pa.string()), b.column(2), b.column(3)]
            yield pa.RecordBatch.from_arrays(cols, ["id", "markup", "lang", "probability", "text_lang", "declared", "host"])

    return run


def page_fields(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """id, text (the html), markup, declared, host, suffix of web pages."""
    host = F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    tag = F.regexp_extract(F.col(html), r"(?i)<html\b([^>]*)", 1)
    declared = F.lower(F.regexp_extract(tag, r"""(?i)[\s"'](?:xml:)?lang\s*=\s*["']?([a-z]{2})""", 1))
    return pages.select(F.col(page).cast("long").alias("id"), F.col(html).cast("string").alias("text"), F.lit(True).alias("markup"), declared.alias("declared"), host.alias("host"), F.substring_index(host, ".", -1).alias("suffix"))


def document_fields(docs: DataFrame, doc: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The same of plain documents: the `lang` column is the declared code, the source stands for the host."""
    return docs.select(F.col(doc).cast("long").alias("id"), F.col(text).cast("string").alias("text"), F.lit(False).alias("markup"), F.lower(F.substring(F.col(lang).cast("string"), 1, 2)).alias("declared"), F.col(source).cast("string").alias("host"), F.lit("").alias("suffix"))


def identify(fields: DataFrame, model: TextModel) -> DataFrame:
    """id, markup, lang, probability, text_lang, declared, host, rejected: one row per row of `fields`."""
    spark = fields.sparkSession
    data = spark.sparkContext.broadcast(model)
    langs = [*model.langs, "und"]
    kinds = range(len(langs))
    code = F.when(F.rlike("declared", F.lit("^[a-z]{2}$")), F.col("declared")).otherwise("")
    cols = fields.select("text", "markup", "id", "markup", code.alias("declared"), F.coalesce("host", F.lit("")).alias("host"), F.coalesce("suffix", F.lit("")).alias("suffix")).toDF("text", "m", "id", "markup", "declared", "host", "suffix")
    told = stash(cols.mapInArrow(lean(_evidence(data)), "id long, markup boolean, declared string, host string, suffix string, any_text boolean, ll array<double>, vote array<double>"))
    sums = [F.sum(F.col("vote")[i]).alias(f"v{i}") for i in kinds]
    hosts = stash(told.groupBy("host", "suffix").agg(F.count("*").alias("rows"), *sums))
    packed = lambda x: F.array(*[F.col(f"{x}{i}") for i in kinds])
    suffixes = small_side(hosts.groupBy("suffix").agg(*[F.sum(f"v{i}").alias(f"v{i}") for i in kinds]).select("suffix", packed("v").alias("at_suffix")), F.size("at_suffix"))
    level = stash(hosts.select("host", "suffix", "rows", packed("v").alias("at_host")).join(suffixes, "suffix"))
    whole = told.groupBy("declared").agg(*sums).collect()  # at most 677 two-letter codes
    matrix = {r["declared"]: [float(r[f"v{i}"] or 0.0) for i in kinds] for r in whole}
    total = [sum(v[i] for v in matrix.values()) for i in kinds]
    with_code = [sum(v[i] for d, v in matrix.items() if d) for i in kinds]
    by_code = F.broadcast(spark.createDataFrame([(d, v) for d, v in matrix.items() if d], "declared string, said array<double>"))
    both = join_heavy(told, level, ["host", "suffix"], "rows").join(by_code, "declared", "left")
    parts = both.select("id", "markup", "declared", "host", "any_text", "ll", "vote", "at_suffix", "at_host", F.coalesce("said", F.array().cast("array<double>")).alias("said"))
    out = parts.mapInArrow(lean(_fuse(langs, total, with_code, sum(1 for d in matrix if d))), "id long, markup boolean, lang string, probability double, text_lang string, declared string, host string")
    return out.withColumn("rejected", F.col("lang") == "und")
