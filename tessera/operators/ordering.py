"""Global places and order statistics without one task that holds all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.lineage import cut

#: Rows that a range has at most; ranges aim at half of it, as their bounds come from samples.
RANGE_ROWS = 500_000
#: Bins that a value range is cut into when a place is looked for, and values that are looked through one by one.
BINS, FEW = 4096, 4096
_ROW_BITS = 33  # of monotonically_increasing_id, below the number of the partition


def global_rank(df: DataFrame, name: str, *order: str) -> DataFrame:
    """``df`` with ``name``: the row's place from 1 in the order of columns ``order`` (which must tell rows apart).

    Rows are dealt to value ranges, as many as they need, and sorted inside; a row's place is its
    number in its range and the sizes of the ranges before. The ranges are kept in the shared
    folder, so that rows are dealt once; only the sizes meet in one task.
    """
    ranges = max(1, -(-2 * df.count() // RANGE_ROWS))
    ranged = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    held = cut(ranged.withColumn("range_", F.monotonically_increasing_id()))
    number = F.shiftright("range_", _ROW_BITS)
    sizes = held.groupBy(number.alias("b_")).agg(F.count("*").alias("n_")).collect()  # a row per range
    before, total = [], 0
    for row in sorted(sizes):
        before.append((row["b_"], total))
        total += row["n_"]
    starts = df.sparkSession.createDataFrame(before, "b_ long, before_ long")
    inside = F.col("range_").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    met = held.join(F.broadcast(starts), number == F.col("b_"))
    return met.select(*df.columns, (F.col("before_") + inside + 1).alias(name))


def nth_value(df: DataFrame, column: str, place: int) -> float | None:
    """The value at ``place`` (from 0) among those of ``column`` that are not null, rising; None past the end.

    Values are counted in bins of equal width, at most BINS of them, and the search goes on in the
    bin that holds the place, between the least and the largest value there, until few are left.
    Every round is one aggregate with partial sums; nothing is sorted or gathered.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where("v is not null")
    now = values.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n")).first()
    if not 0 <= place < now["n"]:
        return None
    while now["low"] < now["high"]:
        inside = values.where(F.col("v").between(now["low"], now["high"]))
        if now["n"] <= FEW:
            return sorted(r["v"] for r in inside.collect())[place]
        width = now["high"] / BINS - now["low"] / BINS
        bin_ = F.floor((F.col("v") - now["low"]) / width) if width else F.when(F.col("v") > now["low"], 1).otherwise(0)
        bins = inside.groupBy(F.least(bin_, F.lit(BINS - 1)).alias("bin")).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n"))
        for now in sorted(bins.collect(), key=lambda r: r["low"]):
            if place < now["n"]:
                break
            place -= now["n"]
    return now["low"]
