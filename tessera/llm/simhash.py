"""SimHash near-duplicates: fingerprints, blocked candidates, pivot distance tables, exact check."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import components, cut, forest

SHINGLE_WORDS, HASH_SEED = 4, 42
#: Fingerprints link at so many differing bits at most.
MOST_BITS = 4
#: Blocks that a key holds at least (enough for 20 million fingerprints), and fingerprints per key value that are aimed at.
LEAST_KEPT, PER_KEY = 2, 8
#: Reference fingerprints of the distance table, 8 distances to a long.
PIVOTS = 16
#: Width of the bands that the distance to the first pivot is cut into: links are in the same band or in neighbouring ones.
BAND = MOST_BITS + 1
#: Parts that the members of a component are dealt to when they meet its smallest doc_id.
SALTS = 64
#: Buckets of more fingerprints are dealt into chunks of so many, compared chunk by chunk.
CHUNK = 1024
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of the XXH64 hashes of word shingles, repeats included; 0 without words."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= SHINGLE_WORDS:
        hashes = [xxhash.xxh64_intdigest(joined, HASH_SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest, seed = xxhash.xxh64_intdigest, HASH_SEED
        last = SHINGLE_WORDS - 1
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts[:-last].tolist(), ends[last:].tolist(), strict=True)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # so that very long texts need little memory
        some = np.array(hashes[at : at + (1 << 16)], np.uint64)
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` as ``(doc_id, fp)``, fp the fingerprint as a signed long."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t.as_py()) for t in batch["text"]), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(apply, "doc_id long, fp long")


def pivots(count: int = PIVOTS, seed: int = 5) -> np.ndarray:
    """Reference fingerprints, pseudorandom and fixed."""
    return np.random.default_rng(seed).integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.arange(
        count, dtype=np.uint64
    ) % np.uint64(2)


def distance_table(prints: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints to the pivots, a row each."""
    return np.bitwise_count(prints[:, None] ^ pivots()[None, :])


def with_distances(prints: DataFrame) -> DataFrame:
    """``prints(fp, first)`` with the distance table as longs ``t0``, ``t1``: computed once per distinct fingerprint, carried from there on."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = distance_table(batch["fp"].to_numpy().view(np.uint64)).astype(np.uint8).reshape(-1, PIVOTS)
            longs = np.ascontiguousarray(table).view(np.int64).reshape(-1, PIVOTS // 8)
            yield pa.RecordBatch.from_arrays([batch["fp"], batch["first"], *(pa.array(np.ascontiguousarray(longs[:, k])) for k in range(2))], ["fp", "first", "t0", "t1"])

    return prints.select("fp", "first").mapInArrow(apply, "fp long, first long, t0 long, t1 long")


def kept_blocks(count: int) -> int:
    """Blocks per key, so that by chance about PER_KEY of ``count`` fingerprints share one. Any number finds all links; more keys are longer, but more."""
    kept = LEAST_KEPT
    while count > PER_KEY * 2.0 ** (64 * kept / (kept + MOST_BITS)) and kept < 4:
        kept += 1
    return kept


def masks(kept: int) -> list[int]:
    """Masks over choices of ``kept`` of kept + MOST_BITS blocks: links agree on all bits of one at least."""
    edges = np.linspace(0, 64, kept + MOST_BITS + 1).astype(int)
    blocks = [((1 << int(b - a)) - 1) << int(a) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return [sum(choice) for choice in combinations(blocks, kept)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _linked(a: np.ndarray, b: np.ndarray, ta: np.ndarray, tb: np.ndarray) -> np.ndarray:
    """Matrix of links between two sets: pairs whose pivot distances differ too much are discarded, the rest verified."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), bool)
    survive = np.ones((len(a), len(b)), bool)
    for k in range(ta.shape[1]):
        survive &= np.abs(ta[:, None, k] - tb[None, :, k]) <= MOST_BITS
    i, j = np.nonzero(survive)
    near = np.bitwise_count(a[i] ^ b[j]) <= MOST_BITS
    out = np.zeros_like(survive)
    out[i[near], j[near]] = True
    return out


def _links_of_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside buckets; rows ``(bucket, side, fp, t0, t1)`` come sorted by bucket, so each is in one run of rows.

    Small buckets are compared all at once by shifting the columns against each other, larger ones
    as matrices. Of a larger bucket only a forest of links is returned, never all pairs.
    """
    small = 24

    def emit(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        both = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), 1), axis=0) if len(a) else np.zeros((0, 2), np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, k]).view(np.int64)) for k in (0, 1)], ["a", "b"])

    def work(rows: np.ndarray) -> pa.RecordBatch:
        bucket, side, fp = (rows[:, k] for k in range(3))
        table = np.ascontiguousarray(rows[:, 3:]).view(np.int8)
        starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        sizes = np.diff(np.append(starts, len(bucket)))
        tiny = np.repeat(sizes <= small, sizes)
        found: tuple[list, list] = ([], [])
        for shift in range(1, small):
            at = np.flatnonzero(tiny[:-shift] & (bucket[shift:] == bucket[:-shift])) if len(bucket) > shift else []
            if not len(at):
                break
            gap = np.abs(table[at] - table[at + shift]).max(1)  # the largest coordinate difference
            at = at[gap <= MOST_BITS]
            at = at[np.bitwise_count(fp[at] ^ fp[at + shift]) <= MOST_BITS]
            found[0].append(fp[at])
            found[1].append(fp[at + shift])
        for start, size in zip(starts[sizes > small], sizes[sizes > small], strict=True):
            some, far, sides = fp[start : start + size], table[start : start + size], side[start : start + size]
            one, two = (sides == 0, sides == 1) if sides.any() else (slice(None), slice(None))
            a, b = forest(some[one], some[two], _linked(some[one], some[two], far[one], far[two]))
            found[0].append(a)
            found[1].append(b)
        return emit(*[np.concatenate(x) if x else np.zeros(0, np.uint64) for x in found])

    held: list[np.ndarray] = []

    def columns(batch: pa.RecordBatch) -> np.ndarray:
        out = np.empty((batch.num_rows, 5), np.uint64)
        for k, name in enumerate(("bucket", "side", "fp", "t0", "t1")):
            out[:, k] = batch[name].to_numpy().astype(np.int64).view(np.uint64)
        return out

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(columns(batch))
        rows = np.concatenate(held)
        turns = np.flatnonzero(rows[1:, 0] != rows[:-1, 0])
        done = turns[-1] + 1 if len(turns) else 0  # the last bucket may go on in the next batch
        if done:
            yield work(rows[:done])
        held = [rows[done:]]
    if held and len(held[0]):
        yield work(held[0])


def links(prints: DataFrame, kept: int | None = None) -> DataFrame:
    """Links ``(a, b)`` that connect distinct fingerprints ``prints(fp, t0, t1)`` as all links of MOST_BITS bits would.

    Candidates agree on some of the blocks, which links must (at most MOST_BITS blocks hold a
    differing bit). A bucket of over CHUNK fingerprints is cut into bands of distance to the first
    pivot, and large bands by hash into chunks; chunks of the same or neighbouring bands are
    compared in a task of their own, other bands are further apart than links can be. So no task
    holds more than two chunks of a bucket. Inside, pivot distances discard and XOR verifies.
    """
    chosen = masks(kept or kept_blocks(prints.count()))
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for k, m in enumerate(chosen)]))
    band = F.floor(F.col("t0").bitwiseAND(F.lit(255)) / BAND).cast("int")
    keyed = prints.select("fp", "t0", "t1", band.alias("band"), keys.alias("key")).select("fp", "t0", "t1", "band", F.xxhash64("key.mask", "key.bits").alias("key"))
    # at most 64 / BAND + 1 bands per key
    counts = (
        keyed.groupBy("key", "band").agg(F.count("*").alias("n"))
        .groupBy("key").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("band", "n"))).alias("bands")).where("n > 1")
    )
    shared = keyed.join(counts, "key")
    chunks = lambda at: F.coalesce(F.ceil(F.element_at("bands", at) / CHUNK).cast("int"), F.lit(0))
    whole = F.struct(F.lit(0).alias("low_band"), F.lit(0).alias("low"), F.lit(0).alias("high_band"), F.lit(0).alias("high"), F.lit(0).alias("side"))

    def met(other_band: Column) -> Column:
        def pair(j: Column) -> Column:
            later = (F.col("band") > other_band) | ((F.col("band") == other_band) & (F.col("own") > j))
            low_band, low = F.least("band", other_band), F.when(later, j).otherwise(F.col("own"))
            return F.struct(low_band.alias("low_band"), low.alias("low"), F.greatest("band", other_band).alias("high_band"), F.when(later, F.col("own")).otherwise(j).alias("high"), later.cast("int").alias("side"))

        count = chunks(other_band)
        return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), pair)).otherwise(F.array().cast("array<struct<low_band:int,low:int,high_band:int,high:int,side:int>>"))

    near = F.concat(*[met((F.col("band") + d).cast("int")) for d in (-1, 0, 1)])
    rows = (
        shared.withColumn("own", F.pmod(F.xxhash64(F.lit(9), "fp"), F.greatest(F.lit(1), chunks(F.col("band"))).cast("long")).cast("int"))
        .select("key", "fp", "t0", "t1", F.explode(F.when(F.col("n") <= CHUNK, F.array(whole)).otherwise(near)).alias("pair"))
        .select(F.xxhash64("key", "pair.low_band", "pair.low", "pair.high_band", "pair.high").alias("bucket"), F.col("pair.side").alias("side"), "fp", "t0", "t1")
    )
    dealt = rows.repartition("bucket").sortWithinPartitions("bucket", "side", "fp")
    return dealt.mapInArrow(_links_of_buckets, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Classes of near-equal texts of ``docs(doc_id, text)``: doc_id, fingerprint, component_id.

    Fingerprints that differ in at most MOST_BITS bits link; component_id is the smallest doc_id
    reachable by links, itself included. One row per row of ``docs``: repeated rows give repeated
    rows; a null or blank text has fingerprint zero and links like any other; a null doc_id is
    never a component_id unless its component has no other. Other columns are ignored.

    Equal texts meet in one fingerprint first, so copies are never paired with each other.
    """
    prints = cut(fingerprints(docs))
    distinct = cut(with_distances(prints.groupBy("fp").agg(F.min("doc_id").alias("first"))))
    roots = components(links(distinct))
    labelled = distinct.select("fp", "first").join(roots, distinct["fp"] == roots["node"], "left")
    least = labelled.where("root is not null").groupBy(F.col("root").alias("l_root")).agg(F.min("first").alias("least"))
    # a component may hold a third of all fingerprints, so its members meet its smallest doc_id in SALTS parts
    salted = least.withColumn("l_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")
    linked = labelled.where("root is not null").withColumn("salt", salt).join(salted, (F.col("root") == F.col("l_root")) & (F.col("salt") == F.col("l_salt")))
    classes = linked.select(F.col("fp").alias("c_fp"), F.col("least").alias("component_id")).unionAll(
        labelled.where("root is null").select(F.col("fp").alias("c_fp"), F.col("first").alias("component_id"))
    )
    return prints.join(classes, prints["fp"] == classes["c_fp"]).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each class of :func:`near_duplicates`, that with the smallest doc_id; all columns as they were.

    Rows without a doc_id can't be told apart and stay. Of repeated rows with one doc_id one stays,
    the first as JSON text.
    """
    judged = near_duplicates(docs)
    kept = cut(judged.where("doc_id = component_id").groupBy(F.col("doc_id").alias("kept_id")).agg(F.count("*").alias("copies")))
    one, more = kept.where("copies = 1").select("kept_id"), kept.where("copies > 1").select("kept_id")
    once = docs.join(one, docs["doc_id"] == one["kept_id"], "left_semi")
    packed = docs.select(F.struct(*docs.columns).alias("doc"))
    repeated = (
        packed.join(more, packed["doc"]["doc_id"] == more["kept_id"], "left_semi")
        .groupBy(F.col("doc.doc_id").alias("key"))
        .agg(F.min_by("doc", F.to_json("doc")).alias("doc"))
        .select("doc.*")
    )
    return once.unionByName(repeated).unionByName(docs.where("doc_id is null"))
