"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context and only its text is
trainable. Turns after the last assistant turn, and conversations without one, end in one context-only
record with an empty loss span, so the output holds every turn.

A turn is ``<|turn|>role<|text|>text<|end|>``. Inside roles and texts a backslash breaks up every control
string and doubles every backslash, so no control string survives and unescaping restores the text.

Defined results: null text and null role are empty; turns are ordered by turn, then role, then text (nulls
first), so ties and repeated rows have a fixed order and each repeated row is a turn; a null conv_id is a
conversation of its own; an empty table gives no records. Only the four columns named are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacloom.llm.common import written

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings of this and of other common templates.
CONTROL = r"<(?=\||/?s>|<SYS|</SYS)|\[(?=/?INST\])"
ASSISTANT = "assistant"


def escaped(text: Column) -> Column:
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, CONTROL, r"$0\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def prefix_target(conversations: DataFrame) -> DataFrame:
    """One record per assistant turn, and a context-only one where a conversation does not end with it.

    Columns: conv_id, example_no, formatted, loss_start and loss_chars (code points of ``formatted``).
    """
    turn = F.struct(
        F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    shown = F.transform(F.col("turns"), lambda t: F.struct(
        F.concat(F.lit(TURN), escaped(t["role"]), F.lit(TEXT)).alias("head"),
        escaped(t["text"]).alias("body"),
        (t["role"] == ASSISTANT).alias("target"),
    ))
    grouped = conversations.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(
        F.sort_array(F.collect_list("t")).alias("turns")
    ).select("conv_id", shown.alias("turns"))
    last = F.size("turns") - 1
    ends = F.filter(
        F.transform("turns", lambda t, i: F.when(t["target"] | (i == last), i)), lambda i: i.isNotNull()
    )
    rows = grouped.select("conv_id", "turns", F.posexplode(ends).alias("example_no", "at"))
    context = F.array_join(
        F.transform(F.slice("turns", F.lit(1), F.col("at")), lambda t: F.concat(t["head"], t["body"], F.lit(END))), ""
    )
    rows = rows.select(
        "conv_id", "example_no", context.alias("context"), F.get("turns", F.col("at")).alias("own")
    )
    prompt = F.concat("context", "own.head")
    return rows.select(
        "conv_id", "example_no",
        F.concat("context", "own.head", "own.body", F.lit(END)).alias("formatted"),
        F.when(F.col("own.target"), F.length(prompt)).otherwise(0).cast("long").alias("loss_start"),
        F.when(F.col("own.target"), F.length("own.body")).otherwise(0).cast("long").alias("loss_chars"),
    )


def turns_of(formatted: Column) -> Column:
    """Roles and texts, read back from a formatted record."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>", -1), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(
        unescaped(F.substring_index(F.substr(p, F.lit(len(TURN) + 1)), TEXT, 1)).alias("role"),
        unescaped(F.substring_index(p, TEXT, -1)).alias("text"),
    ))


def read_back(records: DataFrame) -> DataFrame:
    """Per conversation: its turns and everything under the loss mask, from the records alone."""
    trained = unescaped(F.substr("formatted", F.col("loss_start") + 1, F.col("loss_chars")))
    rows = records.select(
        "conv_id", "example_no", F.length("formatted").alias("chars"), trained.alias("trained"),
        F.length(trained).alias("trained_chars"), "formatted",
    )
    sums = rows.groupBy("conv_id").agg(
        F.sum("chars").cast("long").alias("formatted_chars"),
        F.sum("trained_chars").cast("long").alias("loss_chars"),
        F.sort_array(F.collect_list(F.struct("example_no", "trained"))).alias("replies"),
        F.max_by("formatted", "example_no").alias("whole"),
    )
    turns = turns_of(F.col("whole"))
    told = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return sums.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        "loss_chars",
        F.sha2(F.array_join(F.transform("replies", lambda r: r["trained"]), ""), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def written_records(records: DataFrame) -> DataFrame:
    """Write the records to the shared folder and read them back."""
    return written(records, "chat")
