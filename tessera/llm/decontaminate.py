"""Benchmark decontamination: latent semantic retrieval of passages, then subsequence and answer checks.

Passages of all documents and the benchmark's items are rows of a TF-IDF matrix over the items'
terms. A randomised SVD, distributed over the passages, gives a latent basis; passages whose cosine
with an item in it is high, or that hold much of an item's own weight, are candidates. A candidate
counts if its longest common subsequence of words with the item is long, or a shorter one comes
with the item's answer.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut

#: Passages are windows of three blocks, one block apart.
BLOCK_WORDS, BLOCKS = 16, 3
#: Words that an item is cut into for retrieval, so that a passage holds any piece; pieces overlap by half.
PIECE_WORDS = 32
RANK, OVERSAMPLE = 320, 16
#: Pieces that share a basis; a larger benchmark has more bases, of which so many are sent to the tasks at once.
GROUP_PIECES, GROUPS_AT_ONCE = 400, 4
#: Share of its squared length that every piece keeps in its basis, which gets more directions where it has to.
KEPT = 0.95
#: Terms in more than this share of documents don't tell items apart; each item keeps its five rarest.
STOP_SHARE, LEAST_TERMS = 0.02, 5
#: A passage is a candidate by its cosine with a piece, or by its share of the piece's own squared weights, whatever words stand around.
COSINE, HELD = 0.2, 0.4
#: Terms whose rows of the tasks' matrices are summed together.
SUM_TERMS = 64
#: Words that are worked on at once; longer texts are cut, with an overlap where passages are searched.
SLICE_WORDS = 100_000
#: Share of an item's words in common, in order, that counts alone, and with the answer present.
LCS_ALONE, LCS_WITH_ANSWER = 0.8, 0.5
#: Without an answer of its own, an item's last words are its answer.
ANSWER_WORDS = 5
#: The benchmark is sent to every task; more words than this raise an error.
MAX_BENCHMARK_WORDS = 5_000_000
HITS = "array<struct<item_id:bigint,cosine:double,lcs:double,answer:boolean>>"
_WORD = re.compile(r"\w+")


def word_list(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


class Items:
    """The benchmark as word ids (from 1; 0 is any other word), with answers and retrieval pieces."""

    def __init__(self, rows: Sequence[tuple[int, str | None, str | None]]):
        self.vocabulary: dict[str, int] = {}
        self.ids: list[int] = []
        self.words: list[list[int]] = []
        self.answers: list[list[int]] = []
        for item_id, text, answer in sorted(rows, key=lambda r: (r[0], r[1] or "")):
            found = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in word_list(text)]
            if found and item_id is not None:
                said = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in word_list(answer)]
                self.ids.append(item_id)
                self.words.append(found)
                self.answers.append(said or found[-ANSWER_WORDS:])
        self.pieces = [
            (k, w[at : at + PIECE_WORDS])
            for k, w in enumerate(self.words)
            for at in range(0, max(1, len(w) - PIECE_WORDS // 2), PIECE_WORDS // 2)
        ]


def read_items(benchmark: DataFrame) -> Items:
    """Items of ``benchmark(item_id, text[, answer])``; null ids or texts are left out."""
    size = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    if size > 6 * MAX_BENCHMARK_WORDS:
        raise ValueError("the benchmark is too large to be sent to every task")
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    rows = benchmark.where("item_id is not null and text is not null").select("item_id", "text", answer).distinct()
    return Items([tuple(r) for r in rows.collect()])


def word_ids(docs: DataFrame, items: Items) -> DataFrame:
    """``docs(doc_id, text)`` as ``(doc_id, ids)``: the whole text's words as 32-bit ids of the items' words."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(items.vocabulary)  # bounded by MAX_BENCHMARK_WORDS

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.value.get
        for batch in batches:
            packed = [
                np.array([get(w, 0) for w in word_list(t.as_py())], np.int32).tobytes() for t in batch["text"]
            ]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(packed, pa.binary())], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(apply, "doc_id long, ids binary")


def _unpack(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), np.int32) for x in batch["ids"]]


def document_frequencies(ids: DataFrame, terms: int) -> tuple[np.ndarray, int]:
    """In how many documents each of the items' terms stands, and the number of documents."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(terms + 1, np.int64)
        for batch in batches:
            for doc in _unpack(batch):
                counts[np.unique(doc)] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(terms + 1)), pa.array(counts)], ["term", "n"])

    rows = ids.mapInArrow(apply, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(terms + 1, np.int64)
    for row in rows:
        out[row["term"]] = row["n"]
    return out, ids.count()


def term_weights(items: Items, frequencies: np.ndarray, documents: int) -> tuple[np.ndarray, float]:
    """Weight per term id (0 for terms that are too common), and the weight of any other word."""
    idf = np.log((1 + documents) / (1 + frequencies.astype(float)))
    keep = frequencies <= max(STOP_SHARE * documents, 1)
    for words in items.words:
        rare = sorted(set(words), key=lambda t: (frequencies[t], t))[:LEAST_TERMS]
        keep[rare] = True
    weights = np.where(keep, np.maximum(idf, 0.1), 0.0)
    weights[0] = 0.0
    used = weights[weights > 0]
    return weights, float(used.mean()) if len(used) else 1.0


def _slices(docs: list[np.ndarray], step: int, overlap: int) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """All texts as lists of (text, first word, words), each list of about SLICE_WORDS words; cuts fall on multiples of ``step``."""
    held, size, most = [], 0, SLICE_WORDS // step * step
    for k, doc in enumerate(docs):
        for at in range(0, max(1, len(doc)), most):
            part = doc[at : at + most + overlap]
            if held and size + len(part) > most:
                yield held
                held, size = [], 0
            held.append((k, at, part))
            size += len(part)
    if held:
        yield held


class _Blocks:
    """Blocks of words of some texts: where they are, their squared norms, and their telling terms in order."""

    def __init__(self, parts: list[tuple[int, int, np.ndarray]], weights: np.ndarray, other: float, block: int, local: np.ndarray):
        sizes = np.array([len(p) for _, _, p in parts])
        per = -(-sizes // block)
        first = np.concatenate(([0], np.cumsum(per)))[:-1]
        self.part = np.repeat(np.arange(len(parts)), per)
        self.start = (np.arange(per.sum()) - np.repeat(first, per)) * block
        ids = np.concatenate([p for _, _, p in parts])
        place = np.arange(len(ids)) - np.repeat(np.concatenate(([0], np.cumsum(sizes)))[:-1], sizes)
        at = np.repeat(first, sizes) + place // block
        squares = weights[ids] ** 2
        self.norms = np.bincount(at, squares, minlength=len(self.part)) + other**2 * np.bincount(at[ids == 0], minlength=len(self.part))
        terms = local[ids]
        tell = terms >= 0
        self.known = np.bincount(at[tell], squares[tell], minlength=len(self.part))
        self.terms = terms[tell]
        self.ends = np.searchsorted(at[tell], np.arange(len(self.part) + 1))  # terms of block b: ends[b] to ends[b + 1]

    def summed(self, values: np.ndarray) -> np.ndarray:
        """A value per telling term, summed over the terms of each block."""
        return np.bincount(np.repeat(np.arange(len(self.part)), np.diff(self.ends)), values, minlength=len(self.part))

    def sums(self, blocks: np.ndarray, basis: np.ndarray) -> np.ndarray:
        """Rows of ``basis`` summed over the terms of each block."""
        out = np.zeros((len(blocks), basis.shape[1]), basis.dtype)
        for low in range(0, len(blocks), 4096):
            some = blocks[low : low + 4096]
            sizes = self.ends[some + 1] - self.ends[some]
            begin = np.concatenate(([0], np.cumsum(sizes)))
            where = np.repeat(self.ends[some] - begin[:-1], sizes) + np.arange(begin[-1])
            full = np.flatnonzero(sizes)
            if len(full):
                out[low + full] = np.add.reduceat(basis[self.terms[where]], begin[full], axis=0)
        return out


class Group:
    """Some pieces of the benchmark as unit rows over their own telling terms, numbered from 0; ``local`` is -1 for all other words."""

    def __init__(self, pieces: Sequence[tuple[int, list[int]]], weights: np.ndarray):
        self.owners = [k for k, _ in pieces]
        terms = sorted({t for _, words in pieces for t in words if weights[t] > 0})
        self.local = np.full(len(weights), -1, np.int32)
        self.local[terms] = np.arange(len(terms))
        self.weights = weights[terms]
        self.rows = np.zeros((len(pieces), len(terms)), np.float32)
        for row, (_, words) in zip(self.rows, pieces, strict=True):
            known = [t for t in words if weights[t] > 0]
            np.add.at(row, self.local[known], weights[known])
        self.lengths = np.linalg.norm(self.rows, axis=1)
        self.rows /= np.maximum(self.lengths, 1e-12)[:, None]
        #: The largest share of a piece's squared weights that one word of a passage brings, per term.
        self.reach = (self.rows / self.lengths[:, None]).max(axis=0) * self.weights


def groups(items: Items, weights: np.ndarray) -> Iterator[Group]:
    """All pieces that have telling terms, in groups small enough for one basis."""
    pieces = [(k, words) for k, words in items.pieces if any(weights[t] > 0 for t in words)]
    count = -(-len(pieces) // GROUP_PIECES)
    for g in range(count):
        yield Group(pieces[g * len(pieces) // count : (g + 1) * len(pieces) // count], weights)


def _gram_times(ids: DataFrame, basis: np.ndarray, group: Group, weights: np.ndarray, other: float) -> np.ndarray:
    """A'A times ``basis`` over the passages of all documents; tasks send one matrix each, cut by terms and summed by them."""
    shape, passage, local = basis.shape, BLOCK_WORDS * BLOCKS, group.local
    sent = ids.sparkSession.sparkContext.broadcast((basis * group.weights[:, None]).astype(np.float32))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for parts in _slices(_unpack(batch), passage, 0):
                blocks = _Blocks(parts, weights, other, passage, local)
                full = np.flatnonzero(blocks.ends[1:] > blocks.ends[:-1])
                rows = blocks.sums(full, sent.value) / np.maximum(blocks.norms[full], 1e-9)[:, None]  # a unit row, met twice
                at = np.repeat(np.arange(len(full)), blocks.ends[full + 1] - blocks.ends[full])
                order = np.argsort(blocks.terms, kind="stable")
                terms, at = blocks.terms[order], at[order]
                turn = np.flatnonzero(np.concatenate(([True], terms[1:] != terms[:-1]))) if len(terms) else []
                for k in range(0, len(turn), 256):
                    some = turn[k : k + 256]
                    end = turn[k + 256] if k + 256 < len(turn) else len(terms)
                    total[terms[some]] += np.add.reduceat(rows[at[some[0] : end]], some - some[0], axis=0)
        yield packed((k, total[k * SUM_TERMS : (k + 1) * SUM_TERMS]) for k in range(-(-shape[0] // SUM_TERMS)))

    def packed(chunks: Iterable[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        some = [(k, m.astype(np.float32).tobytes()) for k, m in chunks]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in some], pa.int32()), pa.array([m for _, m in some], pa.binary())], ["chunk", "m"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, m in zip(batch["chunk"].to_pylist(), batch["m"], strict=True):
                part = np.frombuffer(m.as_py(), np.float32).reshape(-1, shape[1])
                sums[k] = sums[k] + part if k in sums else part.astype(np.float64)
        yield packed(sums.items())

    # a task sums the same terms of all matrices as they come, and holds no more than its terms
    sums = ids.mapInArrow(part, "chunk int, m binary").repartition("chunk").mapInArrow(add, "chunk int, m binary")
    total = np.zeros(shape, np.float32)
    for row in sums.collect():  # one matrix
        total[row["chunk"] * SUM_TERMS : (row["chunk"] + 1) * SUM_TERMS] = np.frombuffer(row["m"], np.float32).reshape(-1, shape[1])
    sent.destroy()
    return total * group.weights[:, None].astype(np.float32)


def latent_basis(ids: DataFrame, group: Group, weights: np.ndarray, other: float, rank: int = RANK) -> np.ndarray:
    """Right singular vectors (terms x rank) of the passages and, weighing as much together, the group's pieces.

    Randomised SVD: a random basis through A'A, made orthonormal, then once more for the values.
    What pieces of less than KEPT in that basis lack is added to it.
    """
    queries, terms = group.rows, len(group.weights)
    width = min(rank + OVERSAMPLE, terms)
    q = np.random.default_rng(11).standard_normal((terms, width), np.float32)
    for last in (False, True):
        product = _gram_times(ids, q, group, weights, other)
        focus = queries.T @ (queries @ q)
        focus *= np.float32(max(1.0, np.linalg.norm(product) / max(np.linalg.norm(focus), 1e-12)))
        product += focus
        del focus
        if not last:
            q = np.linalg.qr(product)[0]
    values, turn = np.linalg.eigh((q.T @ product + product.T @ q) / 2)
    return completed(q @ turn[:, np.argsort(-values)[:rank]], queries)


def completed(basis: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """``basis`` with directions added until each unit row of ``queries`` keeps KEPT of its squared length."""
    basis = basis.astype(np.float64)
    while True:
        inside = queries @ basis
        short = np.flatnonzero((inside**2).sum(axis=1) < KEPT)
        if not len(short):
            return basis.astype(np.float32)
        lacking = queries[short] - inside[short] @ basis.T
        _, values, turned = np.linalg.svd(lacking, full_matrices=False)
        more = turned[values > 1e-3 * values[0]].T
        more -= basis @ (basis.T @ more)
        basis = np.hstack([basis, np.linalg.qr(more)[0]])


def longest_common(masks: dict[int, int], length: int, region: Sequence[int]) -> int:
    """Length of the longest common subsequence with an item given as bit masks of its words' places."""
    ones = (1 << length) - 1
    state = ones
    for term in region:
        mask = masks.get(term)
        if mask:
            met = state & mask
            state = ((state + met) | (state - met)) & ones
    return length - state.bit_count()


def _holds(region: list[int], part: list[int]) -> bool:
    return any(region[k : k + len(part)] == part for k in range(len(region) - len(part) + 1))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, hits)`` per row of ``docs(doc_id, text)``: hits an array of (item_id, cosine, lcs, answer).

    All words of all texts are searched, against all items of ``benchmark(item_id, text[, answer])``.
    Null or empty texts have no hits. Items repeated under one id count once. An empty benchmark
    finds nothing. Words are ``\\w`` runs in lower case. Other columns are ignored.
    """
    items = read_items(benchmark)
    if not items.words:
        return docs.select("doc_id", F.array().cast(HITS).alias("hits"))
    ids = cut(word_ids(docs, items))
    frequencies, documents = document_frequencies(ids, len(items.vocabulary))
    weights, other = term_weights(items, frequencies, documents)
    masks = [{} for _ in items.words]
    for mask, words in zip(masks, items.words, strict=True):
        for at, term in enumerate(words):
            mask[term] = mask.get(term, 0) | (1 << at)
    exact = docs.sparkSession.sparkContext.broadcast((masks, [len(w) for w in items.words], items.answers, items.ids, weights))
    found, held = ids, []
    for group in groups(items, weights):
        if len(held) == GROUPS_AT_ONCE:
            found, held = cut(_searched(found, held, exact, other)), []
        basis = latent_basis(ids, group, weights, other)
        queries = group.rows @ basis
        kept = np.linalg.norm(queries, axis=1)
        queries /= kept[:, None]
        held.append((basis * group.weights[:, None].astype(np.float32), queries, group.owners, group.local, HELD * kept * group.lengths, group.reach))
    found = _searched(found, held, exact, other, keep=False)
    return found.select("doc_id", F.transform("hits", lambda h: F.struct(*[h[c].alias(c) for c in ("item_id", "cosine", "lcs", "answer")])).alias("hits"))


def _searched(ids: DataFrame, bases: list, exact: Broadcast, other: float, keep: bool = True) -> DataFrame:
    """``ids(doc_id, ids[, hits])`` with the hits of the pieces of some groups, beside those it has; ids go on if ``keep``."""
    sent, again = ids.sparkSession.sparkContext.broadcast(bases), "hits" in ids.columns

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks, lengths, answers, item_ids, weights = exact.value
        for batch in batches:
            docs = _unpack(batch)
            hits: list[dict[int, tuple[float, float, bool]]] = [{} for _ in docs]
            if again:
                for known, before in zip(hits, batch["hits"].to_pylist(), strict=True):
                    known.update((h["key"], (h["cosine"], h["lcs"], h["answer"])) for h in before)
            for parts in _slices(docs, BLOCK_WORDS, BLOCK_WORDS * (BLOCKS - 1)):
                for matrix, queries, owners, local, enough, reach in sent.value:
                    blocks = _Blocks(parts, weights, other, BLOCK_WORDS, local)
                    part_held = blocks.summed(reach[blocks.terms])
                    all_norms, all_known, all_held = blocks.norms.copy(), blocks.known.copy(), part_held.copy()
                    for ahead in range(1, BLOCKS):
                        same = np.flatnonzero(blocks.part[ahead:] == blocks.part[:-ahead])
                        all_norms[same] += blocks.norms[same + ahead]
                        all_known[same] += blocks.known[same + ahead]
                        all_held[same] += part_held[same + ahead]
                    # the product is at most the known terms' norm, and the share at most the sum of the terms' largest,
                    # so other passages cannot reach the thresholds
                    alive = np.flatnonzero((all_known > 0) & ((all_known >= COSINE**2 * all_norms) | (all_held >= HELD - 1e-6)))
                    for k in range(0, len(alive), 4096):
                        rows = alive[k : k + 4096]
                        total = blocks.sums(rows, matrix)
                        for ahead in range(1, BLOCKS):
                            same = np.flatnonzero(np.append(blocks.part, np.full(BLOCKS, -1))[rows + ahead] == blocks.part[rows])
                            total[same] += blocks.sums(rows[same] + ahead, matrix)
                        products = total @ queries.T
                        norms = np.sqrt(all_norms[rows]).astype(np.float32)
                        near = (products >= COSINE * norms[:, None]) | (products >= enough)
                        for i, piece in zip(*np.nonzero(near), strict=True):
                            doc, offset, _ = parts[blocks.part[rows[i]]]
                            at, item = offset + blocks.start[rows[i]], owners[piece]
                            best = hits[doc].get(item)
                            if best and best[1] >= 1.0:
                                continue
                            region = docs[doc][max(0, at - lengths[item]) : at + BLOCKS * BLOCK_WORDS + lengths[item]].tolist()
                            share = longest_common(masks[item], lengths[item], region) / lengths[item]
                            said = share >= LCS_WITH_ANSWER and _holds(region, answers[item])
                            if (share >= LCS_ALONE or said) and (not best or share > best[1]):
                                hits[doc][item] = (float(products[i, piece] / norms[i]), share, said)
            column = [
                [{"item_id": item_ids[k], "cosine": c, "lcs": s, "answer": a, "key": k} for k, (c, s, a) in sorted(found.items())] for found in hits
            ]
            kind = pa.list_(pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.float64()), ("answer", pa.bool_()), ("key", pa.int64())]))
            out = {"doc_id": batch["doc_id"], "ids": batch["ids"], "hits": pa.array(column, kind)}
            yield pa.RecordBatch.from_pydict(out if keep else {k: out[k] for k in ("doc_id", "hits")})

    return ids.mapInArrow(search, f"doc_id long, {'ids binary, ' if keep else ''}hits {HITS[:-2]},key:bigint>>")


def judge_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, contaminated, n_items, item_ids (ascending, comma-joined), best_lcs (0 for none)."""
    ids = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item_id"])))
    return leaks(docs, benchmark).select(
        "doc_id",
        (F.size("hits") > 0).alias("contaminated"),
        F.size(ids).cast("long").alias("n_items"),
        F.array_join(ids.cast("array<string>"), ",").alias("item_ids"),
        F.coalesce(F.array_max(F.transform("hits", lambda h: h["lcs"])), F.lit(0.0)).alias("best_lcs"),
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns as they were, whose doc_id no contaminated row has; null doc_ids stay."""
    found = judge_leaks(docs, benchmark).where("contaminated").select(F.col("doc_id").alias("leaked_id")).distinct()
    return docs.join(found, docs["doc_id"] == found["leaked_id"], "left_anti")
