"""Phrase collocations: frequent n-grams by Misra-Gries summaries per hash partition, then exact counts."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, salted_join, small

# What ends a piece of text, and what parts the words inside one.
PIECE_ENDS, WORD_ENDS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
#: Words of a phrase at most, its least occurrences, phrases returned per language, per cent of a phrase that a longer one must cover to replace it.
LONGEST, LEAST, TOP, COVERED = 5, 100, 2000, 100
#: Occurrences that a hash partition is meant to get, and hash partitions at least.
PARTITION_MASS, LEAST_PARTITIONS = 1 << 25, 64
#: Counters of a summary, as a multiple of its occurrences divided by the least frequency: more than one, so that few survive that aren't frequent.
SPARE = 8
#: Bits of the table of survivors at most (it is broadcast; where it fills up, more is counted exactly, nothing is lost), and per counter.
MOST_BITS, BITS_PER_COUNTER = 1 << 28, 16
#: Bytes of text that are cut at a time, counters that a task holds before it sends them, counters of a sent row.
TEXT_BYTES, HELD, ROW = 4 << 20, 1 << 21, 1024

_BREAK = b"\xff"  # in no UTF-8 text
_TABLE = bytes(255 if c in PIECE_ENDS else 32 if c in WORD_ENDS else c + 32 if 65 <= c <= 90 else c for c in range(256))
_STEP, _FIRST, _SECOND = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _FIRST
    h = (h ^ (h >> np.uint64(27))) * _SECOND
    return h ^ (h >> np.uint64(31))


class Words:
    """A stretch of one language's text as word numbers: 0 ends a piece, the others stand for ``words``."""

    def __init__(self, lang: str, texts: list[bytes]) -> None:
        self.lang = lang
        found = _BREAK.join(texts).translate(_TABLE).replace(_BREAK, b" \xff ").split()  # blanks are all that split() finds now
        numbers = {_BREAK: 0}
        self.ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in found), np.int64, len(found))
        self.words = list(numbers)
        seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"))
        self.hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.words), np.uint64, len(self.words))
        self.count = int(np.count_nonzero(self.ids))

    def grams(self, most: int, known: np.ndarray | None, tested: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per length up to ``most``: (length, positions, hashes) of the n-grams inside pieces.

        ``known`` is the table of survivors so far: only n-grams whose parts of up to ``tested`` words
        are all in it come; a frequent phrase has no others.
        """
        good = self.ids != 0
        h = _mixed(self.hashes[self.ids])
        for n in range(1, most + 1):
            if n > 1:
                upto = len(self.ids) - n + 1
                if upto <= 0:
                    return
                h = _mixed(h[:upto] * _STEP + self.hashes[self.ids[n - 1 :]])
                good = good[:upto] & good[1 : upto + 1]  # both parts of one word less
            if known is not None and n <= tested:
                good = good.copy()
                at = np.flatnonzero(good)
                good[at[~in_table(known, h[at])]] = False
            at = np.flatnonzero(good)
            yield n, at, h[at]


def in_table(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = hashes >> np.uint64(64 - (len(table) * 8).bit_length() + 1)
    return (table[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    """Texts ``(lang_, text_)`` in stretches of one language and about TEXT_BYTES; texts are never split."""
    for batch in batches:
        langs = batch["lang_"].to_pylist()
        texts = batch["text_"].cast(pa.binary()).to_pylist()
        for lang in sorted(set(langs)):
            some, size = [], 0
            for text in (t for t, other in zip(texts, langs, strict=True) if other == lang):
                some.append(text)
                size += len(text)
                if size >= TEXT_BYTES:
                    yield Words(lang, some)
                    some, size = [], 0
            if some:
                yield Words(lang, some)


def merged(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Counters of several summaries as one, by hash."""
    h, c = np.concatenate(hashes), np.concatenate(counts)
    order = np.argsort(h)
    h, c = h[order], c[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))[: len(h)])
    return h[first], np.add.reduceat(c, first) if len(first) else c


def reduced(hashes: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """A Misra-Gries summary of ``capacity`` counters at most, and what was taken off each counter."""
    if len(counts) <= capacity:
        return hashes, counts, 0
    off = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])  # the largest that has no room
    left = counts > off
    return hashes[left], counts[left] - off, off


def summaries(rows: DataFrame, lengths: tuple[int, int], known: Broadcast | None, partitions: int) -> DataFrame:
    """What tasks send: ``(part, kind, mass, hashes, counts)``, per hash partition a row with the mass (kind 0), then rows of counters (kind 1)."""
    least, most = lengths
    shift = np.uint64(64 - partitions.bit_length() + 1)

    def sent(h: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
        parts = (h >> shift).astype(np.int64)
        edges = np.flatnonzero(np.concatenate(([True], parts[1:] != parts[:-1], [True])))
        out: list[tuple] = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            part = int(parts[a])
            out.append((part, 0, int(c[a:b].sum()), None, None))
            out += [(part, 1, 0, h[k : min(b, k + ROW)].tobytes(), c[k : min(b, k + ROW)].tobytes()) for k in range(a, b, ROW)]
        for k in range(0, len(out), 1000):
            columns = zip(*out[k : k + 1000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["part", "kind", "mass", "hashes", "counts"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None if known is None else np.frombuffer(known.value, np.uint8)
        hs: list[np.ndarray] = []
        cs: list[np.ndarray] = []
        for stretch in _stretches(batches):
            for n, _, h in stretch.grams(most, table, least - 1):
                if n >= least and len(h):
                    h, c = np.unique(h, return_counts=True)
                    hs.append(h)
                    cs.append(c.astype(np.int64))
            if sum(map(len, hs)) > HELD:
                h, c = merged(hs, cs)
                hs, cs = [h], [c]
                if len(h) > HELD // 2:
                    yield from sent(h, c)
                    hs, cs = [], []
        if hs:
            yield from sent(*merged(hs, cs))

    return rows.mapInArrow(each, "part long, kind int, mass long, hashes binary, counts binary")


def survivors(sent: DataFrame, least: int, partitions: int, bits: int) -> DataFrame:
    """Per hash partition its slice of the table of survivors, packed: bits of all hashes that may have ``least`` occurrences.

    A partition's rows come mass first, so that its summary has a capacity of SPARE * mass / least + 1
    counters: what is taken off all of them stays below ``least`` / SPARE, and a hash without a
    counter, or with one that stays below ``least`` with all that was taken off, has fewer occurrences.
    """
    slice_bits = bits // partitions
    shift = np.uint64(64 - bits.bit_length() + 1)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, mass, off, waiting = None, 0, 0, 0
        hs: list[np.ndarray] = []
        cs: list[np.ndarray] = []

        def settle() -> None:
            nonlocal off, waiting
            h, c, taken = reduced(*merged(hs, cs), SPARE * mass // least + 1)
            hs[:], cs[:], off, waiting = [h], [c], off + taken, 0

        def finish() -> Iterator[pa.RecordBatch]:
            if part is not None and hs:
                settle()
                kept = hs[0][cs[0] + off >= least]
                if len(kept):
                    mask = np.zeros(slice_bits, bool)
                    mask[(kept >> shift).astype(np.int64) - part * slice_bits] = True
                    packed = zlib.compress(np.packbits(mask, bitorder="little").tobytes(), 1)
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([packed], pa.binary())], ["part", "packed"])

        for batch in batches:
            for p, kind, m, h, c in zip(*(batch[k].to_pylist() for k in ("part", "kind", "mass", "hashes", "counts")), strict=True):
                if p != part:
                    yield from finish()
                    part, mass, off, waiting = p, 0, 0, 0
                    hs, cs = [], []
                if kind == 0:
                    mass += m
                else:
                    hs.append(np.frombuffer(h, np.uint64))
                    cs.append(np.frombuffer(c, np.int64))
                    waiting += len(hs[-1])
                    if waiting > max(1 << 16, SPARE * mass // least):
                        settle()
        yield from finish()

    return sent.repartition("part").sortWithinPartitions("part", "kind").mapInArrow(merge, "part long, packed binary")


def hash_partitions(least: int, size: int) -> tuple[int, int]:
    """Hash partitions, and bits of the table of survivors, for texts of at most ``size`` words."""
    bits = 1 << max(17, min(MOST_BITS, BITS_PER_COUNTER * size // least).bit_length() - 1)
    return min(1 << max(LEAST_PARTITIONS, -(-size // PARTITION_MASS) - 1).bit_length(), bits // 8), bits


def frequent_table(rows: DataFrame, least: int, longest: int, partitions: int, bits: int) -> np.ndarray:
    """Table of hashes that may be frequent, in three goes: words, pairs of such words, longer phrases of such pairs.

    Every frequent n-gram is in the table; others may be.
    """
    sc = rows.sparkSession.sparkContext
    table, known = np.zeros(bits // 8, np.uint8), None
    for lengths in [(1, 1), (2, 2), (3, longest)]:
        if lengths[1] < lengths[0]:
            continue
        sent = summaries(rows, lengths, known, partitions)
        for row in survivors(sent, least, partitions, bits).collect():  # as many bits in all as the table has
            piece = np.frombuffer(zlib.decompress(row["packed"]), np.uint8)
            table[row["part"] * len(piece) : (row["part"] + 1) * len(piece)] |= piece
        if known is not None:
            known.destroy()
        known = sc.broadcast(table.tobytes())
    known.destroy()
    return table


def exact_counts(stretch: Words, longest: int, known: np.ndarray | None) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Phrases of a stretch, their occurrences and hashes, all its words first, under the empty phrase; a phrase may come more than once."""
    phrases, counts, hashes = [b""], [np.array([stretch.count])], [stretch.hashes[:1]]
    for n, at, h in stretch.grams(longest, known, longest):
        u, first, inverse, c = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        equal = np.ones(len(at), bool)
        for k in range(n):  # words behind one hash that aren't the same words are counted by themselves
            equal &= stretch.ids[at + k] == stretch.ids[at[first][inverse] + k]
        other = np.flatnonzero(~equal)
        np.subtract.at(c, inverse[other], 1)
        starts = np.concatenate((at[first], at[other]))
        phrases += [b" ".join([stretch.words[w] for w in ids]) for ids in stretch.ids[starts[:, None] + np.arange(n)].tolist()]
        counts += [c, np.ones(len(other), np.int64)]
        hashes += [u, h[other]]
    return phrases, np.concatenate(counts), np.concatenate(hashes)


def counted(rows: DataFrame, least: int, longest: int) -> DataFrame:
    """``(lang, phrase, f)``, written to the shared folder: exact counts of all phrases of up to ``longest`` words with ``least`` occurrences, and under the phrase '' of all words.

    Tasks send what survives in rows of up to ROW phrases of one language and hash partition; a
    partition's phrases, no more than its summaries have counters, are added up by one task.
    """
    size = rows.agg(F.sum(F.octet_length("text_"))).first()[0] or 0
    partitions, bits = hash_partitions(least, size // 2 + 1)
    shift = np.uint64(64 - partitions.bit_length() + 1)
    table = rows.sparkSession.sparkContext.broadcast(frequent_table(rows, least, longest, partitions, bits).tobytes())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(table.value, np.uint8)
        for stretch in _stretches(batches):
            phrases, counts, hashes = exact_counts(stretch, longest, known)
            parts = (hashes >> shift).astype(np.int64)
            order = np.argsort(parts, kind="stable")
            edges = np.flatnonzero(np.concatenate(([True], np.diff(parts[order]) != 0, [True]))).tolist()
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                for k in range(a, b, ROW):
                    some = order[k : min(b, k + ROW)]
                    blob = b"\n".join([phrases[i] for i in some.tolist()])  # line ends are in no phrase
                    yield pa.RecordBatch.from_arrays([pa.array([int(parts[some[0]])]), pa.array([stretch.lang]), pa.array([blob], pa.binary()), pa.array([counts[some].tobytes()], pa.binary())], ["part", "lang", "phrases", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: int | None = None
        held: Counter[tuple[str, bytes]] = Counter()

        def kept() -> Iterator[pa.RecordBatch]:
            found = [(lang, phrase, f) for (lang, phrase), f in held.items() if f >= least or not phrase]
            held.clear()
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.string(), pa.binary(), pa.int64()), strict=True)], ["lang", "phrase", "f"])

        for batch in batches:
            for p, lang, phrases, counts in zip(*(batch[k].to_pylist() for k in ("part", "lang", "phrases", "counts")), strict=True):
                if p != part:
                    yield from kept()
                    part = p
                for phrase, f in zip(phrases.split(b"\n"), np.frombuffer(counts, np.int64).tolist(), strict=True):
                    held[lang, phrase] += f
        yield from kept()

    sent = rows.mapInArrow(count, "part long, lang string, phrases binary, counts binary").repartition("part").sortWithinPartitions("part")
    done = cut(sent.mapInArrow(add, "lang string, phrase binary, f long").withColumn("phrase", F.col("phrase").cast("string")))
    table.destroy()
    return done


def _wide(c: str) -> Column:
    return F.col(c).cast("decimal(19,0)")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """The strongest phrases of each language of ``docs(text, lang)``.

    A-Z are lower-cased, texts cut into pieces at ``.,;:!?`` and line ends, pieces into words at
    spaces and tabs. n counts a language's words, f(phrase) its occurrences inside pieces, overlaps
    included. Candidates are phrases of 2 to ``longest`` words with a = f(phrase) >= ``least``. A cut
    after the first k words has l = f(first part), r = f(rest) and the score floor(1000 * a * n / (l * r));
    a candidate has its lowest-scoring cut, of equal ones that with the smallest k. Candidates go
    whose words lie inside a longer candidate with 100 * f(longer) >= ``covered`` * a. What is left
    is ranked per language by score and a, falling, then by phrase in byte order.

    Returns lang, rank (from 1, up to ``top``), phrase, a, l, r, n and score. A null lang is ``und``,
    a null text is empty; repeated rows count repeatedly; an empty table, or one without frequent
    phrases, gives no row. Other columns are ignored.

    No n-gram that is frequent is lost: every hash partition has a Misra-Gries summary with more
    counters than its occurrences divided by ``least``, and the last pass counts what survives
    exactly, by its words. Scores are computed in whole decimals of 38 digits.
    """
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang_"), F.coalesce("text", F.lit("")).alias("text_"))
    known = counted(rows, least, longest)
    totals = known.where("phrase = ''").select("lang", F.col("f").alias("n"))
    phrases = known.where("phrase <> ''")
    words = phrases.withColumn("words", F.split("phrase", " "))
    long = words.where(F.size("words") >= 2).withColumnRenamed("f", "a")

    joined = lambda a, n: F.array_join(F.slice("words", a, n), " ")
    k, rest = F.col("k"), F.size("words") - F.col("k")
    cuts = long.withColumn("k", F.explode_outer(F.sequence(F.lit(1), F.size("words") - 1))).select(
        "lang", F.col("phrase").alias("whole"), "a", "k", F.explode_outer(F.array(F.struct(F.lit(0).alias("side"), joined(1, k).alias("phrase")), F.struct(F.lit(1).alias("side"), joined(k + 1, rest).alias("phrase")))).alias("part")
    )
    cuts = cuts.select("lang", F.col("part.phrase").alias("phrase"), "whole", "a", "k", "part.side")
    weighed = cut(phrases.join(cuts.groupBy("lang", "phrase").agg(F.count("*").alias("weight")), ["lang", "phrase"]))
    sides = salted_join(cuts, weighed, ["lang", "phrase"], "weight", ["whole", "k", "side"])
    both = sides.groupBy("lang", "whole", "a", "k").agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    both = both.join(small(totals), "lang").withColumn("above", F.lit(1000).cast("decimal(4,0)") * _wide("a") * _wide("n")).withColumn("below", _wide("l") * _wide("r"))
    score = F.expr("CAST(above div below AS BIGINT)")
    best = both.withColumn("score", score).groupBy("lang", "whole", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))

    shorter = F.array(joined(1, F.size("words") - 1), joined(2, F.size("words") - 1))
    # phrases one word longer are enough: what a still longer one covers, the one between covers too, as it is at least as frequent
    within = long.where(F.size("words") >= 3).select("lang", F.explode_outer(shorter).alias("whole"), F.col("a").alias("longer")).groupBy("lang", "whole").agg(F.max("longer").alias("longer"))
    left = best.join(within, ["lang", "whole"], "left").where(F.col("longer").isNull() | (_wide("longer") * 100 < _wide("a") * covered))
    out = left.select("lang", F.col("whole").alias("phrase"), "a", "best.l", "best.r", "n", "best.score")

    order = F.desc("score"), F.desc("a"), F.asc("phrase")
    dealt = out.withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(256)))  # of each deal only the first can be among the first of all
    first = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "deal").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
