"""Chat formatting by prefix-target expansion: one example for each assistant turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<turn:", "</turn>"


def escape(text: Column) -> Column:
    """Double every backslash and break up the two control strings with a single one."""
    for old, new in (("\\", "\\\\"), (OPEN, "<\\turn:"), (CLOSE, "<\\/turn>")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def unescape(text: Column) -> Column:
    """Undo :func:`escape`: a backslash stands for the character after it."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_examples(turns: DataFrame) -> DataFrame:
    """Examples of ``turns(conv_id, turn, role, text)``, one for each assistant turn.

    ``formatted`` holds the turns up to and including the reply, each as
    ``<turn:ROLE>TEXT</turn>\\n`` with the role URL-encoded and the text escaped; ``loss_start`` and
    ``loss_end`` (code points, end exclusive) mark the reply's escaped text, the only trainable part.
    A conversation whose last turn isn't an assistant's gets one more row with no trainable part
    (``loss_start = loss_end``), which holds all its turns. ``last_turn`` numbers the last turn
    held, from 1.

    Rows go by turn, ties by role and text; a null turn comes first; a null role or text is empty;
    repeated rows stay. Rows with a null conv_id form one conversation. Memory is bounded by the
    longest conversation; the output of a conversation grows with its turns times its length, as
    the method asks. Other columns of ``turns`` are ignored.
    """
    piece = F.concat(
        F.lit(OPEN), F.url_encode("role"), F.lit(">"), escape(F.col("text")), F.lit(CLOSE + "\n")
    )
    row = F.struct("turn", "role", "text", piece.alias("piece"))
    conversations = (
        turns.select("conv_id", "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(row)).alias("turns"))
    )
    n = F.size("turns")
    wanted = F.filter(
        F.sequence(F.lit(1), n), lambda i: (F.element_at("turns", i)["role"] == "assistant") | (i == n)
    )
    examples = conversations.select("conv_id", "turns", F.explode(wanted).alias("last_turn")).select(
        "conv_id",
        "last_turn",
        F.array_join(F.transform(F.slice("turns", 1, F.col("last_turn")), lambda t: t["piece"]), "").alias("formatted"),
        (F.element_at("turns", F.col("last_turn"))["role"] == "assistant").alias("trains"),
        F.length(escape(F.element_at("turns", F.col("last_turn"))["text"])).alias("reply"),
    )
    end = F.length("formatted") - len(CLOSE + "\n")
    return examples.select(
        "conv_id",
        "last_turn",
        "formatted",
        F.when(F.col("trains"), end - F.col("reply")).otherwise(end).cast("long").alias("loss_start"),
        end.cast("long").alias("loss_end"),
    )


def parse_turns(formatted: Column) -> Column:
    """The turns ``(role, text)`` of a formatted example."""
    pieces = F.filter(F.split(formatted, CLOSE + "\n"), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            F.url_decode(F.regexp_extract(p, f"^{OPEN}([^>]*)>", 1)).alias("role"),
            unescape(F.regexp_replace(p, f"^{OPEN}[^>]*>", "")).alias("text"),
        ),
    )


def trained_text(formatted: Column, start: Column, end: Column) -> Column:
    """The unescaped text under the loss mask."""
    return unescape(F.substring(formatted, (start + 1).cast("int"), (end - start).cast("int")))


def digest_examples(examples: DataFrame) -> DataFrame:
    """One row per conversation, read back from :func:`format_examples`: digests of turns and trained text."""
    read = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "last_turn").alias("whole"),
        F.array_sort(
            F.collect_list(
                F.struct("last_turn", trained_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("t"))
            )
        ).alias("trained"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
    )
    turns, trained = parse_turns(F.col("whole")), F.array_join(F.transform("trained", lambda x: x["t"]), "")
    return read.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(
            F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256
        ).alias("turns_sha256"),
        F.length(trained).cast("long").alias("loss_chars"),
        F.sha2(trained, 256).alias("loss_sha256"),
        "formatted_chars",
    )
