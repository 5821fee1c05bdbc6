"""Line dedup: lines that many documents share stay in one of them. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, salted_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What is stripped from both ends of a line: spaces, tabs, line ends.
BLANKS = " \t\n\x0b\x0c\r"
#: Shorter keys never count as repeated; longer ones do from so many documents on.
LEAST_CHARS, LEAST_DOCS = 40, 5


def stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def lowered(text: Column) -> Column:
    """A-Z lower-cased; other letters stay. Texts of ASCII alone take the short way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _digest(*values: Column) -> list[Column]:
    """Two independent 64-bit hashes."""
    return [F.xxhash64(*values), F.xxhash64(F.lit(1), *values)]


def keyed_lines(rows: DataFrame, *carried: str, least_chars: int = LEAST_CHARS) -> DataFrame:
    """Lines of ``rows(text_, ...)`` whose key has ``least_chars`` code points or more: ``carried``, pos_ and the key's digests k1_, k2_."""
    lines = rows.select(*carried, F.posexplode_outer(F.split("text_", "\n")).alias("pos_", "line_"))
    long = lines.withColumn("line_", stripped(F.col("line_"))).where(F.char_length("line_") >= least_chars)
    first, second = _digest(lowered(F.col("line_")))
    return long.select(*carried, "pos_", first.alias("k1_"), second.alias("k2_"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``docs`` without the lines that ``least_docs`` documents or more share, except in the largest ``id_col`` that holds them.

    Texts are split at ``\\n``; a line's key is the line stripped of blanks and with A-Z lower-cased.
    All lines of a key of ``least_chars`` code points or more that stands in that many different
    documents go, but for those in the document with the largest id holding it, where every copy
    stays. The other lines are joined by ``\\n`` in their order.

    Returns all rows and columns of ``docs`` with the text replaced, plus n_lines (before dropping)
    and n_dropped, which take the place of columns called so. A null text stays null and counts as
    one empty line. Rows with the same id are one document, each with its own text; rows with a null
    id are one document with an id below all others. An empty table gives an empty result.

    Keys are compared by 128 bits of hash. Only digests of long lines are shuffled to count
    documents (a document's repeats combine first), and again to find which positions go; keys with
    many lines are dealt over many tasks. Texts are shuffled once, to meet their positions.
    """
    held = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = docs.select(
        F.col(id_col).alias("id_"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text_"),
        F.struct(*[F.col(f"`{c}`") for c in held if c != text_col]).alias("rest_"),
        F.col(text_col).isNull().alias("null_"),
    )
    marked = F.coalesce(F.col("id_").cast("string"), F.lit("")), F.col("id_").isNull(), F.col("text_")
    named = rows.withColumns(dict(zip(("r1_", "r2_"), _digest(*marked), strict=True)))  # the same for repeated rows, which lose the same positions

    per_doc = keyed_lines(rows, "id_", least_chars=least_chars).groupBy("k1_", "k2_", "id_").agg(F.count("*").alias("c_"))
    keys = per_doc.groupBy("k1_", "k2_").agg(F.count("*").alias("n_"), F.sum("c_").alias("weight_"), F.max("id_").alias("keep_"))
    shared = cut(keys.where(F.col("n_") >= least_docs).select("k1_", "k2_", "weight_", "keep_"))

    met = salted_join(keyed_lines(named, "id_", "r1_", "r2_", least_chars=least_chars), shared, ["k1_", "k2_"], "weight_", ["r1_", "pos_"])
    gone = met.where(~F.col("id_").eqNullSafe(F.col("keep_"))).groupBy("r1_", "r2_").agg(F.collect_set("pos_").alias("gone_"))

    def without(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone_"))
        return F.array_join(F.transform(left, lambda k: F.get(lines, k)), "\n")

    # the array around the lines binds them to a name, so that they are split once and not for each position
    cleaned = F.element_at(F.transform(F.array(F.split("text_", "\n")), without), 1)
    text = F.when(F.col("null_"), F.lit(None)).when(F.col("gone_").isNull(), F.col("text_")).otherwise(cleaned)
    n_lines = (F.char_length("text_") - F.char_length(F.replace("text_", F.lit("\n"), F.lit(""))) + 1).cast("long")
    joined = named.join(gone, ["r1_", "r2_"], "left")
    columns = [text.alias(c) if c == text_col else F.col(f"rest_.`{c}`").alias(c) for c in held]
    return joined.select(*columns, n_lines.alias("n_lines"), F.coalesce(F.size("gone_"), F.lit(0)).cast("long").alias("n_dropped"))


def line_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_dropped and the digest of the text that :func:`dedup_lines` leaves, a row for each row of ``docs(doc_id, text)``."""
    clean = dedup_lines(docs.select("doc_id", "text"), **options)
    return clean.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
