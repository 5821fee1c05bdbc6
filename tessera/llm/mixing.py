"""Mix sources to target weights: fixed-length blocks, draws per shard, index permutations.

Every source's texts are packed into blocks of a fixed number of words. Each output shard draws how
many of its slots each source gets; the k-th slot of a source takes block ``perm(k mod n)`` of its
n blocks, where perm is a pseudorandom permutation of the indices that changes with each pass. Slots
and blocks meet by (source, block) index.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, cut, shared_folder, small

WEIGHTS = (3, 1, 2)
#: Words of a block; only the last block of a part may be shorter.
BLOCK_WORDS = 64
#: Words of a part of a source's stream: what one task packs. Their number grows with the source.
PART_WORDS = 1 << 20
#: Output slots of a shard.
SHARD_SLOTS = 4096
#: Slots that one row of the plan is unrolled to.
SLOT_CHUNK = 1 << 14
#: Rounds of the index permutations.
ROUNDS = 16
SPACES = " \t\n\x0b\f\r"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame, *more: str) -> DataFrame:
    """Size of each row, and a hash of its text, which orders rows that agree in all else."""
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"), *more)


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Per source of ``sizes(source, size)``: rank, source_size and target.

    Sources by code point, null last, weigh ``weights`` repeating and share ``share`` times all
    words. No target is above ``most`` times its source; the excess goes to the others by weight.
    That is one level for all sources that aren't full: those fill first whose limit over weight is
    least, so a running sum in that order finds the level without iterating. The table has a row
    per source, and its windows see all of it.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_fill = Window.orderBy("fill", F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    return (
        totals.withColumn("rank", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")))
        .withColumn("limit", most * F.col("source_size"))
        .withColumn("fill", F.col("limit") / F.col("weight"))
        .withColumn("total", share * F.sum("source_size").over(Window.partitionBy()))
        .withColumn("rest", F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn(
            "full", F.coalesce(F.sum("limit").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        )
        .withColumn("level", (F.col("total") - F.col("full")) / F.col("rest"))
        .withColumn(
            # the level of the first source that doesn't fill up
            "level",
            F.first(F.when(F.col("level") < F.col("fill"), F.col("level")), ignorenulls=True).over(
                by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            ),
        )
        .select(
            "source",
            "rank",
            "source_size",
            F.coalesce(F.least("limit", F.col("level") * F.col("weight")), F.col("limit")).alias("target"),
        )
    )


def in_parts(rows: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """``rows(doc_id, source, size, tie)`` with the columns of their source and ``part``, dealt by hash."""
    table = sources.select(F.col("source").alias("s_source"), "rank", "source_size", "target")
    count = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("source_size") / PART_WORDS).cast("long"))
    part = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size", "tie"), count)
    return rows.join(small(table), F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source").withColumn("part", part)


def part_table(sizes: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """Per part that holds words: rank, part, its number of blocks, and the index of the first in its source."""
    words = in_parts(sizes, sources, seed).where("size > 0").groupBy("rank", "part").agg(F.sum("size").alias("words"))
    blocks = words.select("rank", "part", F.ceil(F.col("words") / BLOCK_WORDS).cast("long").alias("blocks"))
    before = Window.partitionBy("rank").orderBy("part")
    return blocks.select("rank", "part", "blocks", (F.sum("blocks").over(before) - F.col("blocks")).alias("first"))


def plan_slots(sources: DataFrame, parts: DataFrame) -> DataFrame:
    """Per source that holds words: rank, its blocks, its slots (of the target's share) and the slots of the sources before."""
    blocks = parts.groupBy("rank").agg(F.sum("blocks").alias("blocks"))
    slots = F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long")
    met = sources.join(small(blocks), "rank").withColumn("slots", slots)
    return met.select(
        "rank", "blocks", "slots", (F.sum("slots").over(Window.orderBy("rank")) - F.col("slots")).alias("low"),
        F.sum("slots").over(Window.partitionBy()).alias("total"),
    )


def round_keys(seed: int, n: Column, *of: Column) -> Column:
    """Keys of the rounds of a permutation of 0..n-1."""
    return F.transform(F.sequence(F.lit(1), F.lit(ROUNDS)), lambda r: F.pmod(F.xxhash64(F.lit(seed), *of, r), n))


def permuted(x: Column, n: Column, keys: Column) -> Column:
    """Where a keyed permutation of 0..n-1 takes ``x``; exact for any n below 2**62, without products that could overflow.

    Swap-or-not rounds: each key pairs x with key - x mod n, and one hash bit of the pair swaps it
    or doesn't.
    """

    def step(at: Column, key: Column) -> Column:
        other = F.pmod(key - at, n)
        return F.when(F.xxhash64(key, F.greatest(at, other)).bitwiseAND(F.lit(1)) == 1, other).otherwise(at)

    return F.aggregate(keys, x, step)


def draw_slots(plan: DataFrame, seed: int = 7) -> DataFrame:
    """Output slots ``(shard, slot, source_rank, k, block)`` of a :func:`plan_slots` table.

    All slots are dealt to places by a permutation, and SHARD_SLOTS places in turn are a shard. So a
    shard's counts per source are multinomial draws on condition that all shards together give each
    source its slots: independent draws would miss a source's target by the root of its slots, and
    use some blocks of a source at its limit once too often. The k-th slot of a source takes the
    block that the permutation of pass ``k div blocks`` gives for ``k mod blocks``.
    """
    spark = plan.sparkSession
    turns = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / F.col("blocks"))))
    chunks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("count") - 1) / SLOT_CHUNK)))
    first = F.col("chunk") * SLOT_CHUNK
    at = F.explode(F.sequence(first, F.least(first + SLOT_CHUNK, F.col("count")) - 1))
    k = F.col("turn") * F.col("blocks") + F.col("at")
    slots = (
        plan.where("slots > 0")
        .withColumn("turn", turns)
        .withColumn("count", F.least("blocks", F.col("slots") - F.col("turn") * F.col("blocks")))
        .withColumn("chunk", chunks)
        .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "rank", "turn", "chunk")
        .withColumn("block_keys", round_keys(seed, F.col("blocks"), F.col("rank"), F.col("turn")))
        .withColumn("place_keys", round_keys(seed + 1, F.col("total")))
        .withColumn("at", at)
    )
    return slots.select(
        F.col("rank").alias("source_rank"), k.alias("k"), permuted(F.col("at"), F.col("blocks"), F.col("block_keys")).alias("block"),
        permuted(F.col("low") + k, F.col("total"), F.col("place_keys")).alias("place"),
    ).select(F.floor(F.col("place") / SHARD_SLOTS).alias("shard"), (F.col("place") % SHARD_SLOTS).alias("slot"), "source_rank", "k", "block")


def placed(rows: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """``rows(doc_id, source, size, tie, ...)`` with rank, part and start, the place of their first word in their part.

    One shuffle by part, in which the rows then stay.
    """
    order = Window.partitionBy("rank", "part").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id", "size", "tie")
    start = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    return in_parts(rows, sources, seed).withColumn("start", start)


def pack_blocks(docs: DataFrame, sources: DataFrame, parts: DataFrame, seed: int) -> DataFrame:
    """Blocks ``(source, p_rank, p_block, text, n_words, pieces)``: words joined by spaces, pieces (part, start, doc_id, words) in order.

    A text is cut into its words once, in its one row; the pieces of a block are joined where the
    window left them, without another shuffle. A block has at most BLOCK_WORDS words, hence pieces.
    """
    rows = placed(sized(docs.where(F.col("text").rlike(WORD)), "text"), sources, seed)
    first = F.floor(F.col("start") / BLOCK_WORDS)
    last = F.floor((F.col("start") + F.col("size") - 1) / BLOCK_WORDS)

    def pieces(found: Column) -> Column:
        def piece(block: Column) -> Column:
            low = F.greatest(block * BLOCK_WORDS, F.col("start")) - F.col("start")
            high = F.least((block + 1) * BLOCK_WORDS - F.col("start"), F.col("size"))
            held = F.slice(found, (low + 1).cast("int"), (high - low).cast("int"))
            return F.struct(block.alias("block"), F.array_join(held, " ").alias("words"))

        return F.transform(F.sequence(first, last), piece)

    # the array of one array binds the words to a variable, so that they aren't searched again for each piece
    words = F.split(F.trim("text", F.lit(SPACES)), r"[\x20\x09-\x0D]+")
    cut_up = rows.select("source", "rank", "part", "start", "doc_id", F.explode(F.transform(F.array(words), pieces)[0]).alias("p"))
    joined = (
        cut_up.groupBy("rank", "part", F.col("p.block").alias("local"))
        .agg(F.first("source").alias("source"), F.sort_array(F.collect_list(F.struct("start", "doc_id", F.col("p.words").alias("words")))).alias("held"))
        .join(parts.select(F.col("rank").alias("b_rank"), F.col("part").alias("b_part"), "first"), (F.col("rank") == F.col("b_rank")) & (F.col("part") == F.col("b_part")))
    )
    counted = F.transform(
        "held",
        lambda x: F.struct(F.col("part").alias("part"), x["start"].alias("start"), x["doc_id"].alias("doc_id"), F.size(F.split(x["words"], " ")).cast("long").alias("words")),
    )
    return joined.select(
        "source", F.col("rank").alias("p_rank"), (F.col("first") + F.col("local")).alias("p_block"),
        F.array_join(F.transform("held", lambda x: x["words"]), " ").alias("text"), counted.alias("pieces"),
    ).select("source", "p_rank", "p_block", "text", F.aggregate("pieces", F.lit(0).cast("long"), lambda n, x: n + x["words"]).alias("n_words"), "pieces")


def _planned(docs: DataFrame, seed: int, options: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    sizes = cut(sized(docs))
    sources = cut(targets(sizes, **options))
    return sizes, sources, cut(part_table(sizes, sources, seed))


def _filled(docs: DataFrame, sources: DataFrame, parts: DataFrame, seed: int) -> DataFrame:
    blocks = pack_blocks(docs, sources, parts, seed)
    slots = draw_slots(cut(plan_slots(sources, parts)), seed)
    # both sides grow with the corpus, whatever size the plan guesses for the unrolled slots
    return slots.hint("merge").join(blocks, (F.col("source_rank") == F.col("p_rank")) & (F.col("block") == F.col("p_block"))).select(
        "shard", "slot", "source", "source_rank", "k", "block", "text", "n_words", "pieces"
    )


def mixed_blocks(docs: DataFrame, seed: int = 7, **options) -> DataFrame:
    """The mix itself: a row per output slot ``(shard, slot, source, source_rank, k, block, text, n_words, pieces)``.

    ``pieces`` tells in order of which documents the words are: (part, start, doc_id, words), where
    source_rank, part and start, a document's place in its source, tell equal doc_ids apart.
    See :func:`mix` for nulls.
    """
    _, sources, parts = _planned(docs, seed, options)
    return _filled(docs, sources, parts, seed)


def mix(docs: DataFrame, seed: int = 7, path: str | None = None, **options) -> DataFrame:
    """What the mix of ``docs(doc_id, text, source)`` takes of each document, counted in the pieces of :func:`mixed_blocks`.

    Returns doc_id, size, source_size, target (words of its source), taken (words the mix holds of
    it, repeats counted) and source, one row for each row of ``docs``. With ``path`` the mix is
    written there as Parquet first and counted from what was written. A null text has no words; a
    null source is a source of its own, last in order. Rows that agree in doc_id, source and text
    are packed one after the other. Empty tables give empty results. The result depends on the
    rows, ``seed`` and the constants alone, not on partitions or their order. Other columns are
    ignored.
    """
    sizes, sources, parts = _planned(docs, seed, options)
    mixed = _filled(docs, sources, parts, seed)
    if path:
        mixed.write.option("compression", "zstd").parquet(path)
        mixed = docs.sparkSession.read.parquet(path)
    taken = (
        mixed.select("source_rank", F.explode_outer("pieces").alias("p"))  # never empty; outer spares a filter that would cut them twice
        .groupBy("source_rank", F.col("p.part").alias("t_part"), F.col("p.start").alias("t_start"))
        .agg(F.sum("p.words").alias("taken"))
    )
    met = (F.col("rank") == F.col("source_rank")) & (F.col("part") == F.col("t_part")) & (F.col("start") == F.col("t_start"))
    return placed(sizes, sources, seed).hint("merge").join(taken, met & (F.col("size") > 0), "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source"
    )


def written_mix(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """:func:`mix` with the mix written to ``path``, or to a new folder in the shared one."""
    return mix(docs, path=path or f"{shared_folder(docs.sparkSession)}/mix-{uuid.uuid4().hex}", **options)
