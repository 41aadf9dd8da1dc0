"""Chat formatting with a grammar round trip, in DataFrame functions only.

Grammar of the rendered text (deterministic, one pass):

    chat := turn*
    turn := "<|im_start|>" header "\\n" body "<|im_end|>\\n"
    header := role                  body as it is
            | "\\" base64(role)      body escaped

No body and no plain role may hold a control string. A turn is first rendered plainly and parsed again; where the
parser would not give back the very same role and text, it is rendered escaped. Escaping doubles each backslash and
puts one behind the first character of each control string; reading drops one backslash before any character.

Defined results: null text and null role are empty; turns sort by turn (null first), then role, then text, so repeated
rows all stay; a null conversation id is a conversation of its own; a table without rows gives none; other columns are
ignored. A conversation is one output row, so its text must fit a Spark string; turns are gathered in chunks of
CHUNK before the chunks are joined.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, ESC = "<|im_start|>", "<|im_end|>", "\\"
# Control strings of public chat templates.
CONTROL = (
    "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|begin_of_text|>", "<|end_of_text|>", "<|start_header_id|>",
    "<|end_header_id|>", "<|eot_id|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
)
CHUNK = 64
_ANY = "|".join(re.escape(c) for c in CONTROL)


def escape(c: Column) -> Column:
    doubled = F.replace(c, F.lit(ESC), F.lit(ESC * 2))
    return F.regexp_replace(doubled, f"(?s)(?={_ANY})(.)", r"$1\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def _header(part: Column) -> Column:
    return F.substring_index(part, "\n", 1)


def parse_turn(part: Column) -> Column:
    """struct(role, text, at, escaped) of a turn without its end mark; `at`: characters before the body."""
    head = _header(part)
    name = F.substr(head, F.lit(len(START) + 1))
    escaped = F.startswith(name, F.lit(ESC))
    body = F.substr(part, F.length(head) + 2)
    role = F.when(escaped, F.try_to_binary(F.substr(name, F.lit(2)), F.lit("base64")).cast("string")).otherwise(name)
    return F.struct(role.alias("role"), F.when(escaped, unescape(body)).otherwise(body).alias("text"), (F.length(head) + 1).alias("at"), escaped.alias("escaped"))


def _render(role: Column, text: Column, escaped: bool) -> Column:
    if escaped:
        name, body = F.concat(F.lit(ESC), F.replace(F.base64(F.encode(role, "UTF-8")), F.lit("\r\n"), F.lit(""))), escape(text)
    else:
        name, body = role, text
    return F.concat(F.lit(START), name, F.lit("\n"), body)


def _parses(rendered: Column, role: Column, text: Column) -> Column:
    """Does the grammar accept this turn, and does it give back role and text?"""
    inner = F.substr(rendered, F.lit(len(START) + 1))
    back = parse_turn(rendered)
    return ~F.rlike(inner, F.lit(_ANY)) & (back["role"] == role) & (back["text"] == text)


def format_chats(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, source_sha256, source_turns. See the module's text."""
    rows = conversations.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    plain, kept = _render(F.col("role"), F.col("text"), False), _render(F.col("role"), F.col("text"), True)
    rows = rows.select("conv_id", "turn", "role", "text", F.when(_parses(plain, F.col("role"), F.col("text")), plain).otherwise(kept).alias("rendered"), F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(1 << 60))).alias("chunk"))
    item = F.struct("turn", "role", "text", "rendered")
    chunks = rows.groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list(item)).alias("t")).select(
        "conv_id", "chunk", F.size("t").alias("n"),
        F.array_join(F.transform("t", lambda t: F.concat(t["rendered"], F.lit(END + "\n"))), "").alias("formatted"),
        F.array_join(F.transform("t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("source"),
    )
    whole = chunks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "formatted", "source"))).alias("c"), F.sum("n").alias("source_turns"))
    return whole.select("conv_id", F.array_join(F.col("c.formatted"), "").alias("formatted"), F.sha2(F.array_join(F.col("c.source"), ""), 256).alias("source_sha256"), "source_turns")


def parse_chats(formatted: DataFrame) -> DataFrame:
    """Adds turns array<struct<role,text,at,escaped>> and loss_spans array<struct<start,end,escaped>> (characters of
    `formatted`, end exclusive: where the loss mask is on), both read from `formatted` alone."""
    parts = F.split(F.col("formatted"), re.escape(END) + "\\n", -1)
    cut = formatted.withColumn("parts", F.when(F.col("formatted") == "", F.array().cast("array<string>")).otherwise(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))))
    cut = cut.withColumn("turns", F.transform("parts", parse_turn))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long,escaped:boolean>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.length(x["part"])
        span = F.struct((acc["at"] + x["turn"]["at"]).cast("long").alias("start"), end.cast("long").alias("end"), x["turn"]["escaped"].alias("escaped"))
        spans = F.when(x["turn"]["role"] == "assistant", F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((end + len(END) + 1).cast("long").alias("at"), spans.alias("spans"))

    pairs = F.transform(F.arrays_zip("parts", "turns"), lambda z: F.struct(z["parts"].alias("part"), z["turns"].alias("turn")))
    return cut.withColumn("loss_spans", F.aggregate(pairs, start, step, lambda a: a["spans"])).drop("parts")


def chat_digest(conversations: DataFrame) -> DataFrame:
    """The digest columns, all read back from the rendered text, plus whether the round trip gave the source back."""
    back = parse_chats(format_chats(conversations))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.transform("loss_spans", lambda s: F.struct(s["escaped"].alias("e"), F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")).alias("x")))
    loss = F.array_join(F.transform(masked, lambda m: F.when(m["e"], unescape(m["x"])).otherwise(m["x"])), "")
    out = back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"), "source_sha256")
    return out.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", (F.col("turns_sha256") == F.col("source_sha256")).alias("round_trip"))
