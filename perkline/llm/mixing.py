"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Each source serves its documents in a shuffled order, the whole source at most `epochs` times: a stream of words. The
streams are cut into packets, one for each serving of a document. A packet's virtual finish time is the number of words
its source has served up to the packet's end, divided by the source's target. All packets are sorted by it over all
sources (a range partitioning, sums of the ranges, a running sum within each) and the mix is what the budget reaches:
the packet in which the running sum passes the budget is cut there, and all later ones are left out.

A queue of whole documents would miss the targets by a document for each source. As the targets sum to the budget, it
runs out about virtual time 1; the packet that is in service then in each source is therefore cut in three: the words
due by time 1, the next word, and the rest. So each source's taken words differ from its target by at most one word.

Targets: weights share the budget; a source stops at `epochs` times its size and the excess is shared again by weight.
Windows of that run over one row per source: sources, like the weights that users give them, may be millions.

Order within a source: md5 of seed and doc_id (ties, as repeated rows, by doc_id and size), so reruns agree. Running sums
need no task that holds a source: documents fall into ranges of the md5, sums of the ranges give each its offset, and a
window runs within (source, range) alone.

Defined results: null text has size 0; size 0 is never taken; the null source is a source of its own, last in order;
rows that repeat a doc_id, or have none, are queued one by one, and the mixed table takes each as often as it is served
itself; an empty table gives an empty result; a null doc_id is shuffled as the text "null"; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perkline.llm.common import cols_of, fresh, keyed, quoted, replaced, stash

SPACE = r"[\x20\x09-\x0D]"
#: Ranges of a source's shuffle order: three hex digits.
DIGITS = 3
#: Packets of a range in the global sort, about.
RANGE_ROWS = 500_000


def word_count(text: Column) -> Column:
    """Number of runs of other characters than U+0020 and U+0009..U+000D; null counts as empty."""
    edge = lambda c: F.when(F.ascii(c).isin(32, 9, 10, 11, 12, 13), 1).otherwise(0)
    pieces = F.size(F.split(text, SPACE + "+", -1)) - edge(text) - edge(F.right(text, F.lit(1)))
    return F.when(text.isNull() | (text == ""), F.lit(0)).otherwise(pieces).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, epochs: int) -> DataFrame:
    """src, source_size, n (order), target, budget for a table with one row per document (src, source, size).

    Water filling: t = min(epochs * size, level * weight). Sources ordered by epochs * size / weight are full up to
    some point; the level follows from what the full ones leave. Windows here run over one row per source."""
    per = sizes.groupBy("src", "source").agg(F.sum("size").cast("long").alias("source_size"))
    per = per.withColumn("n", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    k = len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("n") - 1) % k + 1).cast("int")))
    per = per.withColumn("cap", (F.col("source_size") * epochs).cast("double"))
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), "n")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    after = by_fill.rowsBetween(0, Window.unboundedFollowing)
    everything = by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    per = per.withColumn("level", (total * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # the first source that its level does not fill fixes the level of all later ones
    per = per.withColumn("open", F.first(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.col("level")), ignorenulls=True).over(everything))
    target = F.when(F.col("open").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("open") * F.col("weight")))
    return per.select("src", "source_size", "n", target.alias("target"), F.least(F.floor(total * share), total * epochs).cast("long").alias("budget"))


def _packets() -> Column:
    """The packets of a serving of the words a .. b of its source: it is cut at the word due at virtual time 1, and
    behind the next."""
    inside = lambda c: F.greatest(F.col("a"), F.least(F.col("b"), c))
    due = F.floor(F.col("target")).cast("long")
    cuts = F.array_sort(F.array_distinct(F.array(F.col("a"), inside(due), inside(due + 1), F.col("b"))))
    return F.zip_with(F.slice(cuts, F.lit(1), F.size(cuts) - 1), F.slice(cuts, F.lit(2), F.size(cuts) - 1), lambda x, y: F.struct(x.alias("x"), y.alias("y")))


def _queue(docs: DataFrame, weights: tuple[int, ...], share: float, epochs: int, seed: str, doc: str, source: str, text: str, row: str | None) -> tuple[DataFrame, DataFrame]:
    """(documents: row, doc_id, size, source_size, target; servings that the budget reaches: row, lap, words, position)."""
    order = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col(doc).cast("string"), F.lit("null"))).cast("binary"))
    own = F.col(source).cast("string")
    # a source's name that is never null, so that windows and joins share a partitioning
    src = F.coalesce(F.concat(F.lit("="), own), F.lit(""))
    number = F.col(row) if row else F.monotonically_increasing_id()
    sizes = stash(docs.select(number.alias("row"), F.col(doc).alias("doc_id"), own.alias("source"), src.alias("src"), word_count(F.col(text).cast("string")).alias("size"), order.alias("ord")))
    placed = sizes.withColumn("bucket", F.substring("ord", 1, DIGITS))
    ranges = placed.groupBy("src", "bucket").agg(F.sum("size").alias("in_bucket"))
    upto = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("src", "bucket", F.coalesce(F.sum("in_bucket").over(upto), F.lit(0)).alias("offset")).join(source_targets(sizes, weights, share, epochs), "src")
    inside = Window.partitionBy("src", "bucket").orderBy("ord", F.col("doc_id").asc_nulls_first(), "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["src", "bucket"])
    placed = stash(placed.select("row", "doc_id", "size", "source_size", "target", "budget", "n", (F.col("offset") + F.col("ahead")).alias("first")))
    laps = placed.where("size > 0 and target > 0").withColumn("lap", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    laps = laps.withColumn("a", F.col("first") + F.col("lap") * F.col("source_size")).withColumn("b", F.col("a") + F.col("size"))
    packets = laps.select("row", "lap", "n", "target", "budget", F.explode(_packets()).alias("p"))
    packets = packets.select("row", "lap", "n", "budget", F.col("p.y").alias("at"), (F.col("p.y") - F.col("p.x")).alias("words"), (F.col("p.y") / F.col("target")).alias("finish"))
    # the global sort: ranges of virtual time, a sum for each, running sums within
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), placed.count() * epochs // RANGE_ROWS)
    ranged = stash(packets.repartitionByRange(parts, "finish", "n", "at").withColumn("range", F.spark_partition_id()))
    starts = ranged.groupBy("range").agg(F.sum("words").alias("in_range"))
    starts = starts.select("range", F.coalesce(F.sum("in_range").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    running = Window.partitionBy("range").orderBy("finish", "n", "at").rowsBetween(Window.unboundedPreceding, -1)
    queue = ranged.withColumn("ahead", F.coalesce(F.sum("words").over(running), F.lit(0))).join(starts, "range")
    queue = queue.withColumn("position", F.col("start") + F.col("ahead")).where(F.col("position") < F.col("budget"))
    queue = queue.withColumn("words", F.least(F.col("words"), F.col("budget") - F.col("position")))
    return placed, queue.groupBy("row", "lap").agg(F.sum("words").alias("words"), F.min("position").alias("position"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, epochs: int = 2, seed: str = "mix", doc: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, and position (the words of the mix before its
    first serving; null where it is not served).

    See the module's text for method and defined results."""
    placed, servings = _queue(docs, weights, share, epochs, seed, doc, source, text, None)
    per = servings.groupBy("row").agg(F.sum("words").alias("taken"), F.min("position").alias("position"))
    return placed.join(per, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "position")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, epochs: int = 2, seed: str = "mix", doc: str = "doc_id", source: str = "source", text: str = "text", position: str | None = None) -> DataFrame:
    """The mix itself, with the columns of `docs`: a document appears once for each serving, cut to the words that the
    budget reaches. `n_chars` follows the text where there is such a column.

    With `position`, that column is added (the words of the mix before the serving) and the rows come in its order."""
    rows, row = keyed(docs)
    key, all_, one, at = (fresh(rows, n) for n in ("_key", "_servings", "_one", position or "_position"))
    placed, servings = _queue(rows, weights, share, epochs, seed, doc, source, text, row)
    plan = servings.join(placed.select("row", "size"), "row").groupBy(F.col("row").alias(key)).agg(F.collect_list(F.struct("words", "position", "size")).alias(all_))
    both = rows.join(plan, F.col(row) == F.col(key)).select(*cols_of(docs.columns), F.explode(all_).alias(one))
    words, size = F.col(one)["words"].cast("int"), F.col(one)["size"]
    # pieces of one word and the space behind it; the first may be leading space alone
    pieces = F.split(F.col(quoted(text)), rf"(?<={SPACE})(?=[^\x20\x09-\x0D])")
    leads = F.when(F.ascii(F.col(quoted(text))).isin(32, 9, 10, 11, 12, 13), 1).otherwise(0)
    cut = F.array_join(F.slice(pieces, F.lit(1), words + leads), "")
    both = replaced(both.select("*", F.col(one)["position"].alias(at)), **{text: F.when(words < size, cut).otherwise(F.col(quoted(text)))})
    if "n_chars" in docs.columns:
        both = replaced(both, n_chars=F.length(F.col(quoted(text))).cast("long"))
    if not position:
        return both.select(*cols_of(docs.columns))
    return both.repartitionByRange(at).sortWithinPartitions(at).select(*cols_of([*docs.columns, at]))
