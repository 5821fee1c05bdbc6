"""Line dedup, phrases and whitening against plain Python on whole small tables, and on edges."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, line_dedup, phrases, whitening
from tessera.llm.common import read

LONG = "This line stands in many documents and is long enough, "
SHARED = [LONG + "Ünïcode 😀", LONG + "two", LONG.upper() + "TWO  "]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def line_edges():
    rows = [(k, "\n".join([SHARED[0], f"own line {k}", "short", "\t" + SHARED[1 + k % 2] + "\r", ""])) for k in range(8)]
    rows += [(7, "\n".join([SHARED[1], "again", SHARED[1]])), (7, "\n".join([SHARED[1], "again", SHARED[1]])), (20, None), (21, ""), (22, "\n\n"), (None, SHARED[1]), (None, SHARED[0] + "\nx")]
    rows += [(30 + k, LONG + "only four hold this one") for k in range(4)] + [(33, LONG + "only four hold this one\n" + LONG + "only four hold this one")]
    return rows + [(40, "\n".join([LONG + str(k % 3) for k in range(30_000)]))] + [(50 + k, LONG + "1") for k in range(4)]


def naive_lines(rows):
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for d, text in rows:
        for line in (text or "").split("\n"):
            held[key(line)].add(d)
    keep = {k: max(x for x in ds if x is not None) for k, ds in held.items() if len(k) >= 40 and len(ds) >= 5}
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if key(x) not in keep or keep[key(x)] == d]
        out.append((d, len(lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [False, True])
def test_lines(spark, sf_dir, monkeypatch, hot):
    if hot:  # so that every shared line is dealt over several tasks
        monkeypatch.setattr(common, "HOT_ROWS", 2)
    edges = spark.createDataFrame(line_edges(), "doc_id long, text string")
    for df in (edges, read(spark, sf_dir, "documents")):
        rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        got = sorted([tuple(r) for r in line_dedup.line_report(df).collect()], key=str)
        assert got == naive_lines(rows)
    assert line_dedup.line_report(edges.limit(0)).count() == 0


def test_lines_keep_columns_and_nulls(spark):
    df = spark.createDataFrame(line_edges(), "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("pos_", "k1_", "weight_", "id_", "line", "a.b", "n_lines")})
    clean = line_dedup.dedup_lines(df)
    assert clean.columns == [c for c in df.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    rows = clean.collect()
    assert len(rows) == df.count() and all(r["pos_"] == r["a.b"] == "mine" for r in rows)
    assert [r["text"] for r in rows if r["doc_id"] == 20] == [None] and [r["n_lines"] for r in rows if r["doc_id"] == 20] == [1]
    assert line_dedup.dedup_lines(df.where("doc_id < 4")).agg(F.sum("n_dropped")).first()[0] == 0


def naive_phrases(rows, least, longest=5, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                for k in range(len(words) - size + 1):
                    f[lang][tuple(words[k : k + size])] += 1
    out = []
    for lang, counts in f.items():
        common_ = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in common_.items():
            if any(len(o) > len(p) and b >= a and any(o[k : k + len(p)] == p for k in range(len(o))) for o, b in common_.items()):
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), " ".join(p), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, _, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p, -a, left, right, n[lang], -s))
    return sorted(out)


def phrase_edges():
    rows = [("New York, new york: the City; of New\tYork\x0bnew york", "en")] * 7 + [("a a a a a a a a", None), ("a a a", "und"), (None, "en"), ("", ""), (" . , \n", None), ("x y! x y? x y. x y", "")]
    return rows + [("ÜBER das Haus \x85 über das Haus 😀 😀 über das haus", "de")] * 4 + [("the very long text goes on " * 20_000, "long"), ("the very long text goes on " * 20_000, "long")]


def test_phrases(spark, sf_dir, monkeypatch):
    edges = spark.createDataFrame(phrase_edges(), "text string, lang string").withColumns({"f": F.lit("x"), "phrase": F.lit(""), "n": F.lit(1)})
    docs = read(spark, sf_dir, "documents")
    for df, least, top in ((edges, 3, 2000), (docs, 12, 40)):
        rows = [(r["text"], r["lang"]) for r in df.select("text", "lang").collect()]
        got = phrases.collocations(df, least=least, top=top)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, got.collect())) == naive_phrases(rows, least, top=top)
    assert phrases.collocations(edges.limit(0)).count() == 0 and phrases.collocations(edges.where("lang = ''")).count() == 0
    monkeypatch.setattr(phrases, "HELD", 2000)  # summaries sent in many pieces, texts cut into many stretches, a tiny table of survivors, hot joins
    monkeypatch.setattr(phrases, "TEXT_BYTES", 5000)
    monkeypatch.setattr(phrases, "MOST_BITS", 1 << 17)
    monkeypatch.setattr(common, "HOT_ROWS", 1)
    rows = [(r["text"], r["lang"]) for r in docs.select("text", "lang").collect()]
    assert sorted(map(tuple, phrases.collocations(docs, least=12, top=40).collect())) == naive_phrases(rows, 12, top=40)


def test_summaries_lose_nothing_frequent():
    """Whatever the order of merging, what is frequent keeps a counter, and counter and deductions bound its occurrences."""
    rng = np.random.default_rng(4)
    for least in (5, 20):
        seen = (rng.zipf(1.2, 20_000) % 3000).astype(np.uint64)
        capacity, off = len(seen) // least + 1, 0
        h, c = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for part in np.array_split(rng.permutation(seen), 37):
            u, k = np.unique(part, return_counts=True)
            h, c, taken = phrases.reduced(*phrases.merged([h, u], [c, k.astype(np.int64)]), capacity)
            off += taken
            assert len(h) <= capacity
        assert off < least
        held = dict(zip(h.tolist(), c.tolist(), strict=True))
        for x, k in Counter(seen.tolist()).items():
            assert held.get(x, 0) <= k <= held.get(x, 0) + off


def test_words_behind_one_hash_are_counted_apart(monkeypatch):
    """With 8 different hashes for all n-grams, counts are still those of the words."""
    text = b"a b c d. a b, a c. e f g h i j k a b; a b c d"
    monkeypatch.setattr(phrases, "_mixed", lambda h: h % np.uint64(7) << np.uint64(61))
    got = Counter()
    for phrase, f, _ in zip(*phrases.exact_counts(phrases.Words("en", [text]), 3, None), strict=True):
        got[phrase.decode()] += int(f)
    want = Counter({"": 21})
    for piece in re.split("[.,;]", text.decode()):
        words = piece.split()
        want.update(" ".join(words[k : k + n]) for n in (1, 2, 3) for k in range(len(words) - n + 1))
    assert got == want


def test_scores_past_64_bits(spark):
    df = spark.createDataFrame([(10**12, 10**13, 10**12, 10**12 + 7)], "a long, n long, l long, r long")
    wide = {c: F.col(c).cast("decimal(19,0)") for c in "anlr"}
    got = df.withColumn("above", F.lit(1000).cast("decimal(4,0)") * wide["a"] * wide["n"]).withColumn("below", wide["l"] * wide["r"]).select(F.expr("CAST(above div below AS BIGINT)")).first()[0]
    assert got == 1000 * 10**12 * 10**13 // (10**12 * (10**12 + 7))


def check_whitening(rows, got, components=8):
    good = [(i, v) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    x = np.floor(1024 * np.array([v for _, v in good], float)) + 100_000
    n, total = len(x), [int(s) for s in x.sum(0)]
    y = x - x.mean(0)
    v = y.T @ y / n
    values, axes = (a[..., ::-1] for a in np.linalg.eigh(v))
    count = min(components, x.shape[1])
    assert len(got) == n * count
    by = defaultdict(list)
    for r in got:
        by[r["vec_id"], r["component"]].append(r)
    for (i, vector), row in zip(good, x.tolist(), strict=True):
        for k in range(1, count + 1):
            r = by[i, k][0]
            assert r["n"] == n and r["deviation"] == int(r["deviation_exact"])
            if sum(j == i for j, _ in good) == 1:
                assert r["deviation"] == sum((n * int(c) - s) ** 2 for c, s in zip(row, total, strict=True))
            assert abs(r["explained"] - values[k - 1] / values.sum()) < 1e-12 and r["identity_error"] < 1e-10
    ids = [i for i, _ in good]
    if len(set(ids)) == n:
        w = np.array([[by[i, k][0]["whitened"] for k in range(1, count + 1)] for i in ids])
        want = y @ axes[:, :count] / np.sqrt(values[:count])
        want *= np.sign((w * want).sum(0))
        assert np.abs(w - want).max() < 1e-8


def test_whitening(spark, sf_dir):
    df = read(spark, sf_dir, "embeddings")
    check_whitening([(r["vec_id"], r["embedding"]) for r in df.collect()], whitening.whiten(df).collect())
    rng = np.random.default_rng(6)
    rows = [(k, [float(x) for x in rng.standard_normal(24) * np.arange(1, 25)]) for k in range(400)]
    bad = [(500, None), (501, [1.0, None] * 12), (502, [float("nan")] * 24), (503, [float("inf")] + [0.0] * 23), (504, [1.0, 2.0]), (505, [])]
    df = spark.createDataFrame(rows + bad + rows[:3], "vec_id long, embedding array<double>").withColumns({"n": F.lit("x"), "ids": F.lit(1), "v": F.lit(2)})
    check_whitening(rows + rows[:3], whitening.whiten(df.repartition(90)).collect())  # as many tasks as are added in two steps


def test_whitening_without_variance_or_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect() == []
    flat = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0, 2.0]), (2, [2.0, 4.0, 4.0]), (None, [4.0, 8.0, 8.0])], schema)).collect()
    assert [(r["vec_id"], r["component"]) for r in flat] == [(1, 1), (2, 1), (None, 1)] and flat[0]["explained"] == pytest.approx(1)
    wide = whitening.whiten(spark.createDataFrame([(k, [2e6 * (k % 2), 1.0]) for k in range(64)], schema)).first()
    assert int(wide["deviation_exact"]) == 64 * 64 * (2_048_000_000 // 2) ** 2 and wide["deviation"] is None


def test_jacobi_davidson_on_hard_spectra():
    rng = np.random.default_rng(8)
    turn = np.linalg.qr(rng.standard_normal((120, 120)))[0]
    for values in (np.r_[[5.0] * 5, [4.999] * 4, np.linspace(1, 2, 111)], np.r_[1e9, 1.0, np.full(118, 1e-3)], np.full(120, 3.0), np.r_[np.ones(4), np.zeros(116)]):
        a = turn @ np.diag(values) @ turn.T
        a = (a + a.T) / 2
        got, vectors = whitening.jacobi_davidson(lambda m, a=a: a @ m, 120, 8)
        assert np.abs(got - np.sort(values)[::-1][:8]).max() <= 1e-12 * values.max()
        assert np.abs(a @ vectors - vectors * got).max() <= 1e-12 * values.max() and np.abs(vectors.T @ vectors - np.eye(8)).max() < 1e-12
