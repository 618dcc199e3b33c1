"""Chat formatting by prefix-target expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template: ``### Role: text</turn>`` and a line feed for each turn.
HEAD, COLON, END = "### ", ": ", "</turn>\n"


def escape(text: Column) -> Column:
    """Put backslashes before backslashes and into ``##`` and ``</turn>``, so that neither marker survives in a text."""
    for plain, kept in (("\\", "\\\\"), ("##", "#\\#"), ("</turn>", "<\\/turn>")):
        text = F.replace(text, F.lit(plain), F.lit(kept))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", target: str = "assistant") -> DataFrame:
    """One example per assistant turn: all turns before it as context, its text alone trainable.

    Returns ``conv_col, example, formatted, loss_start, loss_length``; the last two mark
    the trainable code points of ``formatted`` (from 0), in its escaped form. Turns after
    the last assistant turn make one more example without a trainable part, so nothing
    of a conversation is lost. Turns stand in the order of turn, role and text, nulls
    first; null roles and texts count as empty; repeated rows are turns of their own; a
    null conversation id is a conversation. Other columns are ignored; an empty table
    gives an empty result. An example holds its context by definition, so a
    conversation's turns are gathered in one row.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    head = F.concat(F.lit(HEAD), F.replace(escape(role), F.lit(":"), F.lit("\\:")), F.lit(COLON))
    rows = turns.select(F.col(conv_col).alias("conv"), F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"), head.alias("head"), escape(text).alias("body")).alias("t"))
    conv = rows.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    n = F.size("ts")
    ends = F.filter(F.sequence(F.lit(1), n), lambda k: (F.element_at("ts", k)["role"] == target) | (k == n))
    picked = conv.select("conv", "ts", F.posexplode(ends).alias("example", "k"))
    last = F.element_at("ts", F.col("k"))
    told = F.array_join(F.transform(F.slice("ts", 1, F.col("k") - 1), lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    context = F.concat(told, last["head"])
    return picked.select(
        "conv", "example", last["role"].alias("role"), last["body"].alias("body"), context.alias("context")
    ).select(
        F.col("conv").alias(conv_col), "example", F.concat("context", "body", F.lit(END)).alias("formatted"),
        F.length("context").alias("loss_start"), F.when(F.col("role") == target, F.length("body")).otherwise(0).alias("loss_length"),
    )


def parse_turns(formatted: Column) -> Column:
    """The turns of a formatted text: an array of ``(role, text)``, unescaped; null gives null, an empty text none.

    The pattern of a head takes what it has read for good, so roles of any length are read without recursion.
    """
    parts = F.split(formatted, END)
    head = r"^### ((?:[^\\:]++|\\[\s\S])*+): "
    return F.transform(
        F.slice(parts, 1, F.size(parts) - 1),
        lambda p: F.struct(unescape(F.regexp_extract(p, head, 1)).alias("role"), unescape(F.regexp_replace(p, head, "")).alias("text")),
    )


def digest(examples: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What a reader finds in the examples of each conversation: counts and hashes of its turns and trainable texts.

    ``examples`` are those of ``format_conversations``; other columns are ignored, an empty
    table gives an empty result, a null conversation id is a conversation. A conversation's
    examples are gathered in one row.
    """
    loss = F.expr("substring(formatted, loss_start + 1, loss_length)")
    per = examples.groupBy(conv_col).agg(
        F.max_by("formatted", "example").alias("longest"),
        F.sort_array(F.collect_list(F.struct("example", unescape(loss).alias("loss")))).alias("losses"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
    ).withColumn("turns", parse_turns(F.col("longest"))).withColumn("loss", F.array_join("losses.loss", ""))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return per.select(
        conv_col, F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"), "formatted_chars",
    )
