"""Helpers shared by the operators of this subpackage: lineage cuts and connected components."""

from __future__ import annotations

from itertools import count

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.lineage import cut, shared_folder

__all__ = ["WORD", "components", "cut", "forest", "read", "salted_join", "shared_folder", "small"]

#: One word: what stands between ASCII spaces, tabs and line ends.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df`` to be broadcast if it has at most ``most`` rows, which are counted; larger ones are joined as Spark sees fit."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: Parts that the rows of a join are dealt into at most where keys are hot, and the fewest rows of such a part.
HOT_PARTS, HOT_ROWS = 50_000, 10_000


def salted_join(many: DataFrame, once: DataFrame, keys: list[str], weight: str, spread: list[str]) -> DataFrame:
    """Inner join on ``keys``, which are not null and tell the rows of ``once`` apart, without a hot task.

    ``weight`` of ``once`` says how many rows of ``many`` have its key; it is left out of the result.
    Keys with more than a HOT_PARTS-th of all of them (so fewer than HOT_PARTS keys, which is what
    makes them fit for a broadcast) are dealt over parts by a hash of ``spread`` and meet copies of
    their row there. ``once`` is read three times: pass something that has been cut.
    """
    part = F.greatest(F.lit(HOT_ROWS), F.ceil(F.sum(weight) / HOT_PARTS)).alias("part_")
    sized = once.join(F.broadcast(once.agg(part)))
    hot = sized.where(F.col(weight) > F.col("part_")).select(*keys, F.ceil(F.col(weight) / F.col("part_")).alias("parts_"))
    dealt = many.join(F.broadcast(hot), keys, "left").withColumn("salt_", F.coalesce(F.pmod(F.xxhash64(*spread), "parts_"), F.lit(0)).cast("long"))
    copies = F.explode_outer(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(1), F.ceil(F.col(weight) / F.col("part_"))).cast("long") - 1))
    return dealt.drop("parts_").join(sized.withColumn("salt_", copies).drop("part_", weight), [*keys, "salt_"]).drop("salt_")


def components(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """Connected components of undirected edges ``(a, b)``: rows ``(node, root)``, root the smallest node.

    Alternates large-star and small-star steps, each of them one ``min`` per node (combined before
    the shuffle) and one equi-join, until the edges no longer change. Nodes without an edge to
    another node are not returned. Every round is checkpointed, so a lost executor costs one round.
    ``max_rounds`` is for callers that would rather have an error than more rounds.
    """
    stars = cut(
        edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    )
    before = None
    for done in count():
        state = stars.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h")
        ).first()
        if state["n"] == 0 or state == before:
            break
        if done == max_rounds:
            raise RuntimeError(f"components have not settled after {max_rounds} rounds")
        before = state
        both = stars.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(
            stars.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small_least, "u")
        small = moved.where("v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).unionAll(
            small_least.select(F.col("u").alias("hi"), F.col("m").alias("lo"))
        )
        stars = cut(small.distinct())
    nodes = stars.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return nodes.unionAll(stars.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


def forest(left: np.ndarray, right: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewest links that connect what the links ``hit[i, j]`` between two chunks connect: at most a node less one."""
    n = len(left)
    label = np.arange(n + len(right))
    while True:
        new = label.copy()
        to_right = np.where(hit, label[:n, None], len(label)).min(0, initial=len(label))
        new[n:] = np.minimum(new[n:], to_right)
        to_left = np.where(hit, new[None, n:], len(label)).min(1, initial=len(label))
        new[:n] = np.minimum(new[:n], to_left)
        new = new[new]
        if (new == label).all():
            break
        label = new
    nodes = np.concatenate((left, right))
    child = np.flatnonzero(label != np.arange(len(label)))
    return nodes[child], nodes[label[child]]
