"""Chat formatting with a grammar round trip, in DataFrame functions only.

A conversation's turns, in the order of (turn, role, text), are rendered as

    <s>[INST] role\\ntext</s>   for any role but the assistant's
    <s>[/INST] role\\ntext</s>  for the assistant's

The control strings are <s>, </s>, [INST] and [/INST]; the grammar allows none inside a role or text.
There, a control string is escaped by a backslash after its first character, and one that already has
backslashes there gets one more, so unescaping takes one away and nothing is lost.  In a role, which
ends at the first line break, a line break is written as <br>, and <br> is a control string itself.
A conversation is first rendered as it is and read back by the deterministic parser; one that breaks
the grammar, or doesn't come out identical, is rendered escaped and parsed again; `verified` holds the
last comparison.  Escaping has an inverse and leaves no control string, so a third round is never needed.

The loss mask covers the assistant texts: `loss_spans` holds their places in `formatted`, and what is
read there, unescaped, is `loss_text`.

Defined results: null text or role reads as empty; rows with equal turns follow each other by role and
text, null turns first; a null conv_id is a conversation of its own; an empty table gives no rows;
long texts are rendered whole; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed values of the template.
OPEN, CLOSE, USER, ASSISTANT = "<s>", "</s>", "[INST] ", "[/INST] "
_CONTROL = r"(<|\[)(\\*)(/?s>|/?INST\])"
_ESCAPED = r"(<|\[)\\(\\*)(/?s>|/?INST\])"
BREAK = "<br>"
_ROLE_CONTROL = r"(<|\[)(\\*)(/?s>|br>|/?INST\])"
_ROLE_ESCAPED = r"(<|\[)\\(\\*)(/?s>|br>|/?INST\])"


def escape(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("s>")) | F.contains(text, F.lit("INST]")), F.regexp_replace(text, _CONTROL, r"$1\\$2$3")).otherwise(text)


def unescape(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, _ESCAPED, "$1$2$3")).otherwise(text)


def escape_role(role: Column) -> Column:
    return F.replace(F.regexp_replace(role, _ROLE_CONTROL, r"$1\\$2$3"), F.lit("\n"), F.lit(BREAK))


def unescape_role(role: Column) -> Column:
    return F.when(F.contains(role, F.lit("\\")) | F.contains(role, F.lit(BREAK)), F.regexp_replace(F.replace(role, F.lit(BREAK), F.lit("\n")), _ROLE_ESCAPED, "$1$2$3")).otherwise(role)


def _let(value: Column, f) -> Column:
    """f(value), with the value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _bare(text: Column) -> Column:
    """Whether a control string stands in a text unescaped; the parser has cut at all </s> before."""
    return F.contains(text, F.lit("<s>")) | F.contains(text, F.lit("[INST]")) | F.contains(text, F.lit("[/INST]"))


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), F.when(role == "assistant", F.lit(ASSISTANT)).otherwise(F.lit(USER)), role, F.lit("\n"), text, F.lit(CLOSE))


def parse(formatted: Column) -> Column:
    """Array of (role, text) read back from a rendered conversation; null where it breaks the grammar."""

    def body(p):
        tags = [F.lit(OPEN + t) for t in (USER, ASSISTANT)]
        return F.when(F.startswith(p, tags[0]), F.substring(p, len(OPEN + USER) + 1, 1 << 30)).when(F.startswith(p, tags[1]), F.substring(p, len(OPEN + ASSISTANT) + 1, 1 << 30))

    def fields(b):
        role = F.substring_index(b, "\n", 1)
        return F.when(F.contains(b, F.lit("\n")), F.struct(role.alias("role"), F.substring(b, F.char_length(role) + 2, F.lit(1 << 30)).alias("text")))

    def turn(p):
        checked = lambda t: F.when(~_bare(t["role"]) & ~_bare(t["text"]), F.struct(unescape_role(t["role"]).alias("role"), unescape(t["text"]).alias("text")))
        return _let(body(p), lambda b: _let(fields(b), checked))

    def turns(parts):
        found = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn)
        return F.when(F.element_at(parts, -1) == "", _let(found, lambda ts: F.when(~F.exists(ts, lambda t: t.isNull()), ts)))

    return _let(F.split(formatted, F.lit(CLOSE), -1), turns)


def format_conversations(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, formatted, turns (read back: array of role and text), loss_spans (start and length in
    code points of each assistant text in `formatted`), loss_text (what they cover, unescaped), verified."""
    clean = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # both forms' lengths are summed up over the turns, so that spans need no second pass over a conversation
    size = lambda r, t: F.char_length(r) + F.char_length(t) + len(OPEN + "\n" + CLOSE) + F.when(F.col("role") == "assistant", len(ASSISTANT)).otherwise(len(USER))
    sized = clean.withColumn("size", size(F.col("role"), F.col("text"))).withColumn("escaped_text", F.char_length(escape(F.col("text"))))
    sized = sized.withColumn("escaped_size", size(escape_role(F.col("role")), F.lit("")) + F.col("escaped_text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sized = sized.select(
        "conv_id",
        F.struct(
            F.row_number().over(order).alias("k"), "role", "text",
            (F.sum("size").over(upto) - len(CLOSE) - F.char_length("text")).alias("plain_at"), (F.sum("escaped_size").over(upto) - len(CLOSE) - F.col("escaped_text")).alias("escaped_at"), "escaped_text",
        ).alias("t"),
    )
    whole = sized.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    whole = whole.withColumn("source", F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))
    plain = F.array_join(F.transform("source", lambda t: render(t["role"], t["text"])), "")
    first = whole.withColumn("plain", plain).withColumn("read", parse(F.col("plain")))
    first = first.withColumn("same", F.coalesce(F.col("read") == F.col("source"), F.lit(False)))
    escaped = F.array_join(F.transform("source", lambda t: render(escape_role(t["role"]), escape(t["text"]))), "")
    second = first.withColumn("formatted", F.when(F.col("same"), F.col("plain")).otherwise(escaped))
    said = F.filter("ts", lambda t: t["role"] == "assistant")
    span = lambda at, n: F.transform(said, lambda t: F.struct(t[at].alias("start"), n(t).cast("long").alias("length")))
    spans = F.when(F.col("same"), span("plain_at", lambda t: F.char_length(t["text"]))).otherwise(span("escaped_at", lambda t: t["escaped_text"]))
    read = second.select("conv_id", "source", "formatted", F.when(F.col("same"), F.col("read")).otherwise(parse(F.col("formatted"))).alias("turns"), spans.alias("loss_spans"))
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    return read.select(F.col("conv_id").alias(conv_id), "formatted", "turns", "loss_spans", loss.alias("loss_text"), F.coalesce(F.col("turns") == F.col("source"), F.lit(False)).alias("verified"))
