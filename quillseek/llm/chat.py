"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns of one role are merged into a block;
blocks are concatenated.  A block is START role CONTENT text (TURN text)* END, so the turns of a merged block can be
told apart again.  Control strings inside roles and texts, the template's own and those of common chat
formats, are escaped by an entity at their first character; every `&` is an entity too, which makes that reversible.

The loss mask is a list of spans, in code points of the formatted text: the escaped text of each assistant turn.  Their places
are running sums over the lengths of a conversation's turns, in the partition that has it already.

Defined results: null texts and roles are empty strings; turns are ordered by turn (null first), ties by role and then
text; rows that repeat are turns that repeat; null conversation ids form one conversation; an empty table
gives an empty result; a very long text is one span; other columns, whatever their names, are ignored.  A conversation is one row of the result, so its
turns meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

START, CONTENT, TURN, END = "<|start|>", "<|content|>", "<|turn|>", "<|end|>"
#: Control strings and their escaped forms, in the order of replacement.
ESCAPES = (
    ("&", "&amp;"),
    ("<|", "&lt;|"),
    ("<s>", "&lt;s>"),
    ("</s>", "&lt;/s>"),
    ("<<SYS>>", "&lt;<SYS>>"),
    ("<</SYS>>", "&lt;</SYS>>"),
    ("[INST]", "&#91;INST]"),
    ("[/INST]", "&#91;/INST]"),
)
LOSS_ROLE = "assistant"


def _replace(text: Column, pairs) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escape(text: Column) -> Column:
    return _replace(text, ESCAPES)


def unescape(text: Column) -> Column:
    return _replace(text, (("&lt;", "<"), ("&#91;", "["), ("&amp;", "&")))


def _split(text: Column, mark: str) -> Column:
    return F.split(text, rf"\Q{mark}\E")


def format_conversations(turns: DataFrame) -> DataFrame:
    """turns: conv_id, turn, role, text.  Returns conv_id, formatted, loss_spans (array of start and length)."""
    clean = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_turns = clean.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    changes = F.expr("filter(sequence(0, size(t) - 1), i -> i = 0 OR t[i].role != t[i - 1].role)")
    blocks = F.expr(
        "transform(first, (a, k) -> struct(t[a].role AS role,"
        " transform(slice(t, a + 1, coalesce(get(first, k + 1), size(t)) - a), x -> x.text) AS texts))"
    )
    merged = sorted_turns.withColumn("first", changes).select("conv_id", blocks.alias("blocks"))
    escaped = merged.select(
        "conv_id",
        F.transform("blocks", lambda b: F.struct(b["role"].alias("role"), escape(b["role"]).alias("mark"), F.transform(b["texts"], escape).alias("texts"))).alias("blocks"),
    )

    def body(b: Column) -> Column:
        return F.concat(F.lit(START), b["mark"], F.lit(CONTENT), F.array_join(b["texts"], TURN), F.lit(END))

    def sizes(b: Column) -> Column:
        """For each text of a block how much is between it and the one before, its length, and what is after it in its block."""
        head = F.lit(len(START) + len(CONTENT)) + F.length(b["mark"])
        return F.transform(
            b["texts"],
            lambda x, i: F.struct(
                F.when(i == 0, head).otherwise(len(TURN)).cast("long").alias("before"),
                F.length(x).cast("long").alias("length"),
                F.when(i == F.size(b["texts"]) - 1, len(END)).otherwise(0).cast("long").alias("after"),
                (b["role"] == LOSS_ROLE).alias("loss"),
            ),
        )

    parts = escaped.select("conv_id", F.flatten(F.transform("blocks", sizes)).alias("sizes"), F.array_join(F.transform("blocks", body), "").alias("formatted"))
    # The whole text goes with the first of its turns; the others are numbers.
    turn = F.transform("sizes", lambda x, i: F.struct(x.alias("x"), i.alias("at"), F.when(i == 0, F.col("formatted")).alias("formatted")))
    each = parts.select("conv_id", F.explode(turn).alias("turn")).select("conv_id", "turn.at", "turn.x.*", "turn.formatted")
    upto = F.sum(F.col("before") + F.col("length") + F.col("after")).over(Window.partitionBy("conv_id").orderBy("at"))
    span = F.struct((upto - F.col("after") - F.col("length")).alias("start"), F.col("length"))
    spans = each.select("conv_id", "formatted", F.when(F.col("loss"), span).alias("span"))
    return spans.groupBy("conv_id").agg(F.first("formatted", True).alias("formatted"), F.array_sort(F.collect_list("span")).alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of role and text, one for each row that went in."""
    blocks = F.filter(_split(formatted, END), lambda b: b != "")

    def turns(b: Column) -> Column:
        parts = _split(F.substring(b, len(START) + 1, 1 << 30), CONTENT)
        return F.transform(_split(parts[1], TURN), lambda x: F.struct(unescape(parts[0]).alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss_spans, lambda s: unescape(F.substr(formatted, s["start"].cast("int") + 1, s["length"].cast("int")))), "")


def digest(formatted: DataFrame) -> DataFrame:
    """What can be read back from the output of `format_conversations`."""
    back = formatted.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
