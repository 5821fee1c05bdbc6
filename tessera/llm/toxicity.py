"""Toxicity: a chain of linear classifiers, each fed the earlier ones' out-of-fold probabilities.

The labelled sample is bounded, so a model is fitted in one task; the models of a category, one per
fold and one for all rows, are fitted side by side. Scoring is one pass over all documents.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut

#: Labelled documents that the models are fitted on at most, drawn by hash of doc_id.
MAX_LABELLED = 10_000
#: Lengths of the beginnings of words that are terms beside the words.
STEMS = (3, 4, 5, 6, 7)
FOLDS = 3
#: From this probability of its last category on, a document counts as toxic.
THRESHOLD = 0.3
ITERATIONS = 30
#: Penalties of the linear models on the sum of weights' sizes and of half their squares.
L1, L2 = 0.00045, 0.00005
#: Terms that a fit works on at once.
FIT_TERMS = 1 << 20
#: Words whose terms a scoring task remembers before it starts anew.
REMEMBERED = 200_000

_RUN = re.compile(r"[^\W\d_]+")


def terms_of_word(word: str) -> set[int]:
    """A lower-case word and its beginnings, as 32-bit hashes; beginnings carry what inflected or compound words share."""
    return {zlib.crc32(word[:k].encode("utf-8", "surrogatepass")) for k in (*STEMS, len(word))}


def words_of(text: str | None) -> set[str]:
    """Distinct lower-case letter runs; a null text has none."""
    return set(_RUN.findall(text.lower())) if text else set()


def training_rows(docs: DataFrame, labels: DataFrame, categories: Sequence[str], bound: int = MAX_LABELLED) -> DataFrame:
    """doc_id, the categories as 0/1 doubles, fold and ``terms`` (packed hashes) of at most ``bound`` labelled documents."""
    judged = (
        labels.where(F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(*[F.max(c).cast("double").alias(c) for c in categories])
        .na.drop()
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(bound)
        .withColumnRenamed("doc_id", "label_id")
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(judged), F.col("doc_id") == F.col("label_id"))  # at most `bound` rows
    once = texts.groupBy("doc_id", *categories).agg(F.min("text").alias("text"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, set[int]] = {}
        for batch in batches:
            packed = []
            for text in batch["text"]:
                found = [known.setdefault(w, terms_of_word(w)) if w not in known else known[w] for w in words_of(text.as_py())]
                packed.append(np.array(sorted(set().union(*found)), np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("doc_id", *categories)), pa.array(packed, pa.binary())], ["doc_id", *categories, "terms"])

    schema = "doc_id long, " + ", ".join(f"`{c}` double" for c in categories) + ", terms binary"
    return once.mapInArrow(apply, schema).withColumn("fold", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(FOLDS)))


def telling_terms(rows: DataFrame, count: int) -> np.ndarray:
    """Hashes of the terms that can get a weight at all, in order.

    The loss changes with a weight by at most the share of rows that hold its term, so the L1
    penalty holds the weights of all rarer terms at 0: leaving those out changes nothing.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.frombuffer(t.as_py(), np.uint32) for batch in batches for t in batch["terms"]]
        terms, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(terms.astype(np.int64)), pa.array(n.astype(np.int64))], ["term", "n"])

    counts = rows.select("terms").mapInArrow(apply, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    # at most the sample's terms divided by the least count, and the sample is bounded
    kept = counts.where(F.col("n") > L1 * count * len_share(FOLDS)).select("term").toPandas()["term"]
    return np.sort(kept.to_numpy(np.int64)).astype(np.uint32)


def len_share(folds: int) -> float:
    """Share of the rows that the smallest fit sees, roughly; halved, so that no fold of less than half of that is harmed."""
    return 0.5 * (1 - 1 / folds)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit_logistic(terms: list[np.ndarray], dense: np.ndarray, y: np.ndarray, width: int) -> tuple[float, np.ndarray]:
    """Intercept and weights of an elastic-net logistic regression on binary ``terms`` (below ``width``) and ``dense`` columns.

    Quasi-Newton steps inside the orthant that the L1 penalty allows (OWL-QN): directions from the
    last few gradients, and no step takes a weight across 0.
    """
    n, size = max(len(y), 1), width + dense.shape[1]
    lengths = np.array([len(t) for t in terms], np.int64)
    # rows are worked on in stretches of about FIT_TERMS terms, so that only their columns are held for all rows
    turns = np.flatnonzero(np.diff(np.concatenate(([0], np.cumsum(lengths))) // FIT_TERMS, prepend=-1))
    stretches = []
    for a, b in zip(turns, np.append(turns[1:], len(terms)), strict=True):
        if a < b:
            stretches.append((slice(a, b), np.concatenate(terms[a:b]), lengths[a:b]))
            terms[a:b] = [None] * (b - a)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        """Penalised loss, and the gradient of all but the L1 penalty; the intercept comes last and has no penalty."""
        margin, by_term = dense @ w[width:size] + w[size], np.zeros(width)
        for some, columns, held in stretches:
            sums, ends = np.concatenate(([0.0], np.cumsum(w[columns]))), np.cumsum(held)
            margin[some] += sums[ends] - sums[ends - held]
        rest = _logistic(margin) - y
        for some, columns, held in stretches:
            by_term += np.bincount(columns, np.repeat(rest[some], held), width)
        gradient = np.concatenate((by_term, dense.T @ rest, [rest.sum()])) / n
        gradient[:size] += L2 * w[:size]
        value = np.logaddexp(0, margin).sum() / n - (y * margin).sum() / n + L2 / 2 * (w[:size] ** 2).sum()
        return value + L1 * np.abs(w[:size]).sum(), gradient

    def steepest(w: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        """The gradient with the L1 penalty, 0 where the penalty holds a weight at 0."""
        slope = gradient + L1 * penalised * np.sign(w)
        at_zero = (w == 0) & penalised
        slope[at_zero] = np.sign(gradient[at_zero]) * np.maximum(np.abs(gradient[at_zero]) - L1, 0)
        return slope

    penalised = np.arange(size + 1) < size
    share = min(max(float(y.mean()) if len(y) else 0.0, 1e-6), 1 - 1e-6)
    w = np.zeros(size + 1)
    w[size] = np.log(share / (1 - share))
    value, gradient = loss(w)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(ITERATIONS):
        slope = steepest(w, gradient)
        if np.abs(slope).max() < 1e-6:
            break
        turn, used = slope.copy(), []
        for s, g, by in reversed(past):
            used.append(float(s @ turn) / by)
            turn -= used[-1] * g
        if past:
            turn *= past[-1][2] / float(past[-1][1] @ past[-1][1])
        for (s, g, by), alpha in zip(past, reversed(used), strict=True):
            turn += (alpha - float(g @ turn) / by) * s
        turn[turn * slope <= 0] = 0  # only downhill
        if not turn.any():
            turn = slope
        orthant = np.where(w != 0, np.sign(w), -np.sign(slope))
        length = 1.0 if past else min(1.0, 1 / float(np.abs(slope).sum()))
        while True:
            moved = w - length * turn
            moved[penalised & (moved * orthant < 0)] = 0
            after, changed = loss(moved)
            if after <= value + 1e-4 * float(slope @ (moved - w)) or length < 1e-9:
                break
            length /= 2
        s, g = moved - w, changed - gradient
        by = float(s @ g)
        if by > 1e-12:
            past = [*past[-9:], (s, g, by)]
        done = value - after < 1e-5 * value
        w, value, gradient = moved, after, changed
        if done:
            break
    return float(w[size]), w[:size]


class ChainModel:
    """The fitted chain: per category the intercept, the weights other than 0 by term hash, and those of the earlier probabilities."""

    def __init__(self, categories: Sequence[str], links: list[tuple[float, dict[int, float], list[float]]]):
        self.categories, self.links = list(categories), links
        self.known = set().union(*(link[1] for link in links)) if links else set()

    def scorer(self) -> Callable[[str | None], list[float]]:
        """A function from a text to the categories' probabilities, each link fed with those before it."""
        telling: dict[str, set[int]] = {}
        dull: set[str] = set()

        def probabilities(text: str | None) -> list[float]:
            held: set[int] = set()
            for word in words_of(text) - dull:
                found = telling.get(word)
                if found is None:
                    if len(telling) + len(dull) >= REMEMBERED:
                        telling.clear()
                        dull.clear()
                    found = terms_of_word(word) & self.known
                    if found:
                        telling[word] = found
                    else:
                        dull.add(word)
                held |= found
            out: list[float] = []
            terms = sorted(held)  # so that equal texts get equal sums
            for bias, weights, earlier in self.links:
                score = bias + sum(weights.get(t, 0.0) for t in terms) + sum(w * p for w, p in zip(earlier, out, strict=True))
                out.append(1 / (1 + math.exp(-max(-500.0, min(500.0, score)))))
            return out

        return probabilities

    def score(self, docs: DataFrame) -> DataFrame:
        """``docs(doc_id, text)`` as doc_id and ``p_<category>``."""
        names = [f"p_{c}" for c in self.categories]

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            probabilities = self.scorer()
            for batch in batches:
                found = [probabilities(t.as_py()) for t in batch["text"]]
                columns = [pa.array([p[k] for p in found], pa.float64()) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], ["doc_id", *names])

        return docs.select("doc_id", "text").mapInArrow(apply, "doc_id long, " + ", ".join(f"`{n}` double" for n in names))

    def keep(self, docs: DataFrame, threshold: float) -> DataFrame:
        """The rows of ``docs``, all columns, whose last category's probability is below ``threshold``."""

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            probabilities = self.scorer()
            for batch in batches:
                yield batch.filter(pa.array([probabilities(t.as_py())[-1] < threshold for t in batch["text"]], pa.bool_()))

        return docs.mapInArrow(apply, docs.schema)


def _fitted(rows: DataFrame, category: str, earlier: Sequence[str], kept: np.ndarray, models: Sequence[int]) -> dict[int, tuple[float, dict[int, float], list[float]]]:
    """Links of ``category``: model f is fitted without fold f, model FOLDS on all rows."""
    width, padded = len(kept), np.append(kept.astype(np.int64), -1)

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        def known(packed: bytes) -> np.ndarray:
            terms = np.frombuffer(packed, np.uint32)
            at = np.searchsorted(kept, terms)
            return at[padded[at] == terms].astype(np.int32)

        terms = [known(x) for x in group.pop("terms")]
        bias, weights = fit_logistic(terms, group[[f"p_{c}" for c in earlier]].to_numpy(float), group[category].to_numpy(float), width)
        some = np.flatnonzero(weights[:width])
        return pd.DataFrame({
            "model": [group["model"].iloc[0]], "bias": [bias], "terms": [kept[some].astype(np.int64).tolist()], "weights": [weights[some].tolist()], "earlier": [weights[width:].tolist()],
        })

    each = rows.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models]))).where("fold <> model")
    out = each.groupBy("model").applyInPandas(fit, "model int, bias double, terms array<long>, weights array<double>, earlier array<double>").collect()
    return {r["model"]: (r["bias"], dict(zip(r["terms"], r["weights"], strict=True)), list(r["earlier"])) for r in out}


def _out_of_fold(rows: DataFrame, category: str, earlier: Sequence[str], links: dict[int, tuple[float, dict[int, float], list[float]]]) -> DataFrame:
    """``rows`` with the probability of ``category`` from the model that did not see the row."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = [batch[f"p_{c}"].to_pylist() for c in earlier]
            out = []
            for k, (terms, fold) in enumerate(zip(batch["terms"], batch["fold"].to_pylist(), strict=True)):
                bias, weights, more = links[fold]
                score = bias + sum(weights.get(t, 0.0) for t in np.frombuffer(terms.as_py(), np.uint32).tolist()) + sum(w * p[k] for w, p in zip(more, before, strict=True))
                out.append(float(_logistic(np.float64(score))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, f"p_{category}"])

    schema = ", ".join(f"`{n}` {t}" for n, t in [*rows.dtypes, (f"p_{category}", "double")])
    return rows.mapInArrow(apply, schema)


def fit_chain(rows: DataFrame, categories: Sequence[str]) -> ChainModel:
    """Fit the chain on :func:`training_rows`.

    A link sees the terms and the probabilities of the earlier categories. For fitting, these come
    from models that did not see the row's fold, so later links learn how far to trust them; for
    scoring, from the model fitted on all rows. Without rows every probability is 0; a category of
    one class only gets that class's share, held off 0 and 1.
    """
    rows = cut(rows)
    count = rows.count()
    if not count:
        return ChainModel(categories, [(-500.0, {}, [0.0] * k) for k in range(len(categories))])
    kept, links, earlier = telling_terms(rows, count), [], []
    for category in categories:
        last = category == categories[-1]
        found = _fitted(rows, category, earlier, kept, [FOLDS] if last else [*range(FOLDS), FOLDS])
        links.append(found[FOLDS])
        if not last:
            missing = found[FOLDS]  # a fold that holds all rows, as only tiny samples have
            rows = _out_of_fold(rows, category, earlier, {f: found.get(f, missing) for f in range(FOLDS)})
            earlier = [*earlier, category]
    return ChainModel(categories, links)


def judge_toxicity(
    docs: DataFrame, labels: DataFrame, categories: Sequence[str] = ("low_quality", "toxic"), threshold: float = THRESHOLD
) -> DataFrame:
    """Score every row of ``docs(doc_id, text)`` by a chain fitted on ``labels(doc_id, <categories>)``.

    Returns doc_id, ``p_<category>`` and toxic (the last category's probability reaches
    ``threshold``), one row per row of ``docs``. A null or empty text is scored on no words.
    Repeated rows get equal scores; of labels repeated for a doc_id the largest counts; labels with
    nulls are left out. Without labels nothing is toxic. At most ``MAX_LABELLED`` labelled
    documents are fitted on; all documents are scored. Other columns are ignored.
    """
    model = fit_chain(training_rows(docs, labels, categories), categories)
    scored = model.score(docs)
    last = f"p_{categories[-1]}"
    return scored.select("doc_id", *[f"p_{c}" for c in categories], (F.col(last) >= threshold).alias("toxic"))


def drop_toxic(docs: DataFrame, labels: DataFrame, categories: Sequence[str] = ("low_quality", "toxic"), threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns as they were, that :func:`judge_toxicity` would not call toxic."""
    model = fit_chain(training_rows(docs, labels, categories), categories)
    return model.keep(docs, threshold)


def low_quality_labels(labels: DataFrame) -> DataFrame:
    """The ``labels`` table as the chain's categories: low quality first, then toxic."""
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
