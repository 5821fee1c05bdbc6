"""Secret scan: fixed patterns, and a battery of randomness tests with length-aware discovery control."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut

# The base kinds in their order, as (kind, pattern, least length, group the length counts).
BASE = [
    (
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        6,
        2,
    ),
    ("access", "AKIA[A-Z0-9]+", 20, 0),
    ("hex", "[0-9a-f]+", 24, 0),
]
RANDOM = "random"
#: A run of encoding characters, one of them a digit, that could hold a key.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+={0,2}"
# Encodings by name: what a token of it looks like, and its alphabet in order.
ENCODINGS = [
    ("hex", "^(?=.*[0-9])(?=.*[a-f])[0-9a-f]{20,}$", "0123456789abcdef"),
    ("HEX", "^(?=.*[0-9])(?=.*[A-F])[0-9A-F]{20,}$", "0123456789ABCDEF"),
    ("base32", "^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]{20,}=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    (
        "base64",
        "^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/]{16,}={0,2}$",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    ),
    (
        "base64url",
        "^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9_-]{16,}={0,2}$",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    ),
]
#: Expected share of ordinary text among the tokens that are reported as secrets, per encoding and length class.
FALSE_DISCOVERIES = 0.1
#: Length classes: twice the binary logarithm of a token's length; longer tokens count as the last.
CLASSES = range(8, 17)
#: Bins of ln x, the battery's statistic: the first one's lower end, their width and number. p is that of a bin's upper end.
LOWEST, WIDTH, BINS = -3.0, 0.05, 240
#: ln x above which a random token is not (one in 2,000 is); tokens there, if there are so many, show how the corpus's own text spreads.
CLEAR, ENOUGH = math.log(12.0), 100
#: The least p-value that is told apart, and the least spread of ln x that a null has.
LEAST_P, LEAST_SPREAD = 1e-12, 0.15
# The p-values of TEXT_QUANTILES and their normal quantiles.
P_STEPS, P_NORMAL = (0.002, 0.01, 0.05, 0.2), (-2.878, -2.326, -1.645, -0.842)
# What identifiers, paths and numbers are made of, by encoding; from these come the p-values.
TEXT_WORDS = (
    "get set user name value item list data file path index count config client server request response handler manager service "
    "factory build test main source node tree event state table query result error message thread stream buffer version update "
    "create delete default option parse format print open close read write start stop begin end first last next size type"
).split()
HEX_WORDS = "dead beef cafe babe face feed fade decade added bead deed ace bad cab dad fee 0000 1111 1234 2024 2023 9999 0001 00ff abcd 100 255 10 12 7 42".split()
def spans(text: Column, pattern: str, kind: str, rank: int) -> Column:
    """All matches of ``pattern``, leftmost first and not overlapping: structs (start, rank, end, kind, match).

    The matches and the pieces between them alternate, so running sums of their lengths are the
    offsets (code points, end exclusive).
    """
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.length(pair["match"])
        one = F.struct(
            start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"),
            pair["match"].alias("match"),
        )
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,match:string>>")
    pairs = F.zip_with(
        found, F.slice(between, 1, F.size(found)), lambda m, g: F.struct(m.alias("match"), g.alias("gap"))
    )
    walked = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), walked).otherwise(empty)


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns that are long enough, by start, then kind as listed."""
    return F.array_sort(F.concat(*[_base_kind(text, rank) for rank in range(len(BASE))]))


def _base_kind(text: Column, rank: int) -> Column:
    kind, pattern, least, group = BASE[rank]
    if not group:
        # A run of one character class is searched with its least length at once: the same matches, fewer to list.
        return spans(text, pattern[:-1] + "{%d,}" % (least - len("AKIA") if kind == "access" else least), kind, rank)
    return F.filter(
        spans(text, pattern, kind, rank), lambda s: F.length(F.regexp_extract(s["match"], pattern, group)) >= least
    )


def _of_rank(rank: int) -> Column:
    return F.filter("secret_spans", lambda s: s["rank"] == rank)


def with_fields(items: Column, **fields) -> Column:
    """Structs of the array ``items`` with fields added; each is computed once, from the fields before."""
    for name, value in fields.items():
        items = _with_field(items, name, value)
    return items


def _with_field(items: Column, name: str, value) -> Column:
    return F.transform(items, lambda s: s.withField(name, value(s)))


def battery(tokens: Column) -> Column:
    """Structs with ``body`` and ``alphabet`` plus ``p``: their p-value under uniform random symbols.

    Three tests joined by Fisher's method: chi-squared of symbol counts (exact mean and variance,
    normal tail); runs above and below the alphabet's middle; correlation of neighbouring symbol
    values. Tails follow Abramowitz and Stegun 26.2.17. Each is linear in the token.
    """
    zero = F.lit(0.0)
    values = lambda s: F.transform(F.split(s["body"], ""), lambda c: (F.instr(s["alphabet"], c) - 1).cast("double"))
    pairs = lambda s: F.zip_with(
        F.slice(s["values"], 1, F.size(s["values"]) - 1),
        F.slice(s["values"], 2, F.size(s["values"])),
        lambda x, y: F.struct(x.alias("a"), y.alias("b")),
    )
    squares = lambda s: F.aggregate(
        F.split(s["alphabet"], ""),
        zero,
        lambda acc, c: acc + F.pow(s["n"] - F.length(F.replace(s["body"], c, F.lit(""))), F.lit(2.0)),
    )
    serial = lambda s: F.aggregate(
        s["pairs"], zero, lambda acc, p: acc + (p["a"] - s["middle"]) * (p["b"] - s["middle"])
    )
    measured = with_fields(
        tokens,
        n=lambda s: F.length(s["body"]).cast("double"),
        size=lambda s: F.length(s["alphabet"]).cast("double"),
        middle=lambda s: (s["size"] - 1) / 2,
        values=values,
        pairs=pairs,
        squares=squares,
        runs=lambda s: 1 + F.size(F.filter(s["pairs"], lambda p: (p["a"] > s["middle"]) != (p["b"] > s["middle"]))),
        high=lambda s: F.size(F.filter(s["values"], lambda v: v > s["middle"])).cast("double"),
        expected=lambda s: 2 * s["high"] * (s["n"] - s["high"]) / s["n"] + 1,
        spread=lambda s: F.sqrt(F.abs((s["expected"] - 1) * (s["expected"] - 2) / (s["n"] - 1))),
        serial=serial,
        z_chi=lambda s: (s["size"] * s["squares"] / s["n"] - s["n"] - s["size"] + 1)
        / F.sqrt(2.0 * (s["size"] - 1) * (s["n"] - 1) / s["n"]),
        z_runs=lambda s: F.when(s["spread"] > 0, F.abs(s["runs"] - s["expected"]) / s["spread"]).otherwise(F.lit(99.0)),
        z_serial=lambda s: F.abs(s["serial"]) * 12 / ((s["size"] * s["size"] - 1) * F.sqrt(s["n"] - 1)),
    )
    for name in ("chi", "runs", "serial"):
        measured = _tail(measured, name)
    return with_fields(
        measured,
        x=lambda s: -(F.log(s["p_chi"]) + F.log(F.least(2 * s["p_runs"], F.lit(1.0))) + F.log(F.least(2 * s["p_serial"], F.lit(1.0)))),
        p=lambda s: F.greatest(F.exp(-s["x"]) * (1 + s["x"] + s["x"] * s["x"] / 2), F.lit(1e-300)),
    )


def _tail(items: Column, name: str) -> Column:
    """Adds ``p_<name>``: P(Z > z_<name>) of the standard normal, never 0."""
    half = lambda s: s["t"] * (
        0.319381530 + s["t"] * (-0.356563782 + s["t"] * (1.781477937 + s["t"] * (-1.821255978 + s["t"] * 1.330274429)))
    )
    tail = lambda s: F.exp(-s["z_" + name] * s["z_" + name] / 2) / 2.5066282746310002 * s["half"]
    out = with_fields(items, t=lambda s: 1 / (1 + 0.2316419 * F.abs(s["z_" + name])), half=half, tail=tail)
    return _with_field(
        out, "p_" + name, lambda s: F.greatest(F.when(s["z_" + name] >= 0, s["tail"]).otherwise(1 - s["tail"]), F.lit(1e-300))
    )


def text_null(spark: SparkSession, each: int = 2000) -> DataFrame:
    """How random ordinary text looks: ``(code, class, x)`` of ``each`` made-up tokens per encoding and length class.

    Tokens are words in the encoding's letters, joined as in identifiers, paths and numbers, of the
    least length of their class; longer ones look less random still.
    """
    ids = spark.range(each).select("id", F.explode(F.array(*[F.lit(c) for c in CLASSES])).alias("class"), F.explode(F.array(*[F.lit(k) for k in range(len(ENCODINGS))])).alias("code"))
    pick = lambda words, i, salt: F.element_at(words, (F.pmod(F.xxhash64("id", "code", "class", i, F.lit(salt)), F.size(words)) + 1).cast("int"))
    words, hexes = (F.array(*[F.lit(w) for w in some]) for some in (TEXT_WORDS, HEX_WORDS))
    joints = F.array(F.lit(""), F.lit(""), F.lit(""), F.lit("/"), F.lit("2"))
    dashes = F.array(F.lit("_"), F.lit("-"), F.lit(""), F.lit("7"))
    made = F.transform(
        F.sequence(F.lit(1), F.lit(90)),
        lambda i: F.when(F.col("code") == 0, pick(hexes, i, 1))
        .when(F.col("code") == 1, F.upper(pick(hexes, i, 1)))
        .when(F.col("code") == 2, F.concat(F.upper(pick(words, i, 1)), F.when(i % 3 == 0, "2").otherwise("")))
        .when(F.col("code") == 3, F.concat(F.initcap(pick(words, i, 1)), pick(joints, i, 2)))
        .otherwise(F.concat(pick(words, i, 1), pick(dashes, i, 2))),
    )
    alphabets = F.array(*[F.lit(alphabet) for *_, alphabet in ENCODINGS])
    body = F.substring(F.array_join(made, ""), F.lit(1), F.ceil(F.pow(F.lit(2.0), F.col("class") / 2)).cast("int"))
    token = F.array(F.struct(body.alias("body"), F.element_at(alphabets, F.col("code") + 1).alias("alphabet")))
    return ids.select("code", "class", battery(token)[0]["x"].alias("x"))


# Quantiles of text_null at P_STEPS, per encoding as listed and length class from the least on.
TEXT_QUANTILES = [
    [(4.33, 6.14, 8.81, 13.0), (8.45, 10.2, 13.4, 19.0), (13.3, 16.0, 21.1, 28.4), (21.9, 25.3, 32.4, 41.9), (34.5, 38.9, 48.6, 63.5), (60.6, 65.8, 80.1, 104.0), (92.5, 111.0, 133.0, 171.0), (186.0, 206.0, 240.0, 299.0), (327.0, 368.0, 442.0, 540.0)],
    [(3.93, 6.05, 8.97, 13.6), (7.46, 9.89, 13.8, 18.8), (12.6, 15.8, 19.7, 27.2), (19.2, 25.3, 32.1, 42.4), (34.0, 41.2, 50.1, 63.9), (58.9, 67.8, 81.3, 104.0), (94.9, 113.0, 138.0, 170.0), (179.0, 201.0, 237.0, 299.0), (339.0, 364.0, 422.0, 526.0)],
    [(0.553, 0.884, 1.64, 2.89), (1.02, 1.69, 2.74, 4.61), (2.42, 3.65, 5.19, 8.4), (5.71, 7.66, 10.9, 17.2), (15.2, 19.3, 25.8, 37.2), (38.5, 47.5, 60.0, 83.2), (99.5, 113.0, 142.0, 182.0), (224.0, 262.0, 313.0, 399.0), (547.0, 610.0, 691.0, 693.0)],
    [(0.665, 0.97, 1.76, 3.37), (1.91, 2.46, 3.73, 6.55), (4.85, 5.78, 8.97, 14.4), (13.6, 17.0, 22.4, 33.4), (34.2, 40.0, 52.4, 70.5), (88.2, 102.0, 125.0, 160.0), (207.0, 233.0, 278.0, 353.0), (492.0, 544.0, 620.0, 693.0), (692.0, 692.0, 693.0, 694.0)],
    [(1.11, 1.74, 2.83, 4.89), (2.67, 3.72, 6.04, 10.1), (7.88, 9.81, 13.7, 21.6), (23.4, 27.2, 36.0, 51.3), (55.3, 66.5, 84.0, 111.0), (147.0, 165.0, 197.0, 249.0), (343.0, 373.0, 442.0, 531.0), (694.0, 694.0, 695.0, 696.0), (695.0, 696.0, 697.0, 698.0)],
]


def tested(text: Column) -> Column:
    """Candidate tokens of ``text`` in a known encoding: structs (start, end, code, class, step), ``step`` the bin of ln x."""
    found = F.filter(spans(text, CANDIDATE, RANDOM, len(BASE)), lambda s: s["match"].rlike("[A-Za-z]"))

    def code_of(s: Column) -> Column:
        code = F.lit(None).cast("int")
        for i, (_, looks, _) in reversed(list(enumerate(ENCODINGS))):
            code = F.when(s["match"].rlike(looks), i).otherwise(code)
        return code

    alphabets = F.array(*[F.lit(alphabet) for *_, alphabet in ENCODINGS])
    coded = F.filter(with_fields(found, code=code_of), lambda s: s["code"].isNotNull())
    judged = with_fields(
        battery(with_fields(coded, body=lambda s: F.rtrim(s["match"], F.lit("=")), alphabet=lambda s: F.element_at(alphabets, s["code"] + 1))),
        **{"class": lambda s: F.greatest(F.lit(CLASSES[0]), F.least(F.lit(CLASSES[-1]), F.floor(2 * F.log2(s["n"])).cast("int")))},
    )
    bin_ = lambda x: F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.log(F.greatest(x, F.lit(1e-3))) - LOWEST) / WIDTH).cast("int")))
    return F.transform(
        judged,
        lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), s["code"].alias("code"), s["class"].alias("class"), bin_(s["x"]).alias("step")
        ),
    )


def normal_tail(z: float) -> float:
    """P(Z < z) of the standard normal."""
    return 0.5 * math.erfc(-z / math.sqrt(2))


def built_in_null(code: int, cls: int) -> tuple[float, float]:
    """Mean and spread of ln x of :func:`text_null`: the line through its least and its most frequent quantile."""
    quantiles = TEXT_QUANTILES[code][cls - CLASSES[0]]
    spread = max(LEAST_SPREAD, (math.log(quantiles[-1]) - math.log(quantiles[0])) / (P_NORMAL[-1] - P_NORMAL[0]))
    return math.log(quantiles[-1]) - P_NORMAL[-1] * spread, spread


def corpus_null(counts: list[int]) -> tuple[float, float] | None:
    """Mean and spread of ln x of the corpus's own text, from bin counts; None where there is too little or it can't be told from random.

    Only what is above CLEAR counts, where there are next to no random tokens, however many the
    corpus holds: the normal distribution whose part above CLEAR has their mean and variance.
    """
    seen = [(LOWEST + (k + 0.5) * WIDTH, n) for k, n in enumerate(counts) if LOWEST + k * WIDTH >= CLEAR]
    total = sum(n for _, n in seen)
    if total < ENOUGH:
        return None
    mean = sum(x * n for x, n in seen) / total
    variance = sum((x - mean) ** 2 * n for x, n in seen) / total
    mu, spread = mean, max(LEAST_SPREAD, math.sqrt(variance))
    for _ in range(200):
        a = (CLEAR - mu) / spread
        if a > 0:  # most of it would be below
            return None
        hazard = math.exp(-a * a / 2) / math.sqrt(2 * math.pi) / normal_tail(-a)
        mu, spread = mean - spread * hazard, max(LEAST_SPREAD, math.sqrt(variance / (1 + a * hazard - hazard * hazard)))
    return mu, spread


def scanned(docs: DataFrame) -> DataFrame:
    """``docs`` with ``secret_base`` (spans of the fixed patterns) and ``secret_tested`` (judged candidates); both are pruned when not used."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({"secret_base": base_spans(text), "secret_tested": tested(text)})


def discovery_rates(found: DataFrame) -> dict[tuple[int, int], tuple[list[float], list[float]]]:
    """Per encoding and length class, p and the false discovery rate (q) of each bin of ln x.

    p is the chance that ordinary text of that encoding and length looks as random: the larger one
    of two normal tails of ln x, that of the built-in null and that of the corpus's own text. q is
    Benjamini-Hochberg's over all candidates of all rows of :func:`scanned`, on counts per bin:
    encodings times classes times bins, so what reaches the driver does not grow with the input.
    """
    counts = found.select(F.explode("secret_tested").alias("t")).groupBy("t.code", "t.class", "t.step").agg(F.count("*").alias("n")).collect()
    classes: dict[tuple[int, int], list[int]] = {}
    for row in counts:
        classes.setdefault((row["code"], row["class"]), [0] * BINS)[row["step"]] = row["n"]
    return {(code, cls): _rates(code, cls, by_bin) for (code, cls), by_bin in classes.items()}


def _rates(code: int, cls: int, by_bin: list[int]) -> tuple[list[float], list[float]]:
    nulls = [built_in_null(code, cls), corpus_null(by_bin)]
    p, q = [], []
    total, below = sum(by_bin), 0
    for k, n in enumerate(by_bin):
        end = LOWEST + (k + 1) * WIDTH
        p.append(max(LEAST_P, *(normal_tail((end - null[0]) / null[1]) for null in nulls if null)) if k < BINS - 1 else 1.0)
        below += n
        q.append(min(1.0, p[-1] * total / below) if below else 1.0)
    for k in range(BINS - 2, -1, -1):
        q[k] = min(q[k], q[k + 1])
    return p, q


def _discovered(found: DataFrame, rates: dict[tuple[int, int], tuple[list[float], list[float]]]) -> DataFrame:
    """``secret_spans`` from the columns of :func:`scanned`, and ``secret_tests``: all candidates with their p and q."""
    names = F.array(*[F.lit(name) for name, *_ in ENCODINGS])
    place = lambda code, cls: code * len(CLASSES) + cls - CLASSES[0]
    tables = []
    for k in (0, 1):
        table: list[list[float]] = [[] for _ in range(len(ENCODINGS) * len(CLASSES))]
        for (code, cls), both in rates.items():
            table[place(code, cls)] = [float(f"{v:.4g}") for v in both[k]]
        tables.append(F.from_json(F.lit(json.dumps(table)), "array<array<double>>"))  # one constant, whatever its size
    of = lambda table, t: F.coalesce(F.get(F.get(table, place(t["code"], t["class"])), t["step"]), F.lit(1.0))
    judged = F.transform(
        "secret_tested",
        lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.element_at(names, t["code"] + 1).alias("encoding"), of(tables[0], t).alias("p"), of(tables[1], t).alias("q")),
    )
    fresh = F.filter(
        "secret_tests",
        lambda t: (t["q"] <= FALSE_DISCOVERIES) & ~F.exists("secret_base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])),
    )
    more = F.transform(
        fresh,
        lambda t: F.struct(t["start"].alias("start"), F.lit(len(BASE)).alias("rank"), t["end"].alias("end"), F.lit(RANDOM).alias("kind"), F.lit("").alias("match")),
    )
    out = found.withColumn("secret_tests", judged).withColumn("secret_spans", F.array_sort(F.concat("secret_base", more)))
    return out.drop("secret_base", "secret_tested")


def find_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with ``secret_spans``: per row an array of (start, rank, end, kind, match), by start, then kind.

    Kinds: assign, access and hex by pattern; ``random`` for other tokens in a known encoding that
    the battery finds too random for ordinary text, unless they overlap a pattern's span. Beside it
    ``secret_tests`` lists every token in a known encoding, those of the patterns included: (start,
    end, encoding, p, q). p is the chance that text of that encoding and length looks as random, q
    the false discovery rate at which the token is reported. Offsets count code points, end
    exclusive. Null texts have no spans. Each row is judged by itself but for the rates, which come
    from one pass over all rows; so repeated rows give repeated results and an empty table an empty
    one. All columns are kept; those named as the four columns here are replaced.
    """
    clean = docs.drop("secret_base", "secret_tested", "secret_tests", "secret_spans")
    found = scanned(clean)
    return _discovered(found, discovery_rates(found))


def listed(found: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan_report(docs: DataFrame) -> DataFrame:
    """:func:`report` of ``docs``, whose texts are read once: spans and candidates, which are few, are kept for the second step."""
    found = cut(scanned(docs.select("doc_id", "text")).drop("text"))
    return report(_discovered(found, discovery_rates(found)))


def report(found: DataFrame) -> DataFrame:
    """One row per row of :func:`find_secrets`: counts per base kind, digest of the base spans, all spans, all tests."""
    base = F.filter("secret_spans", lambda s: s["rank"] < len(BASE))
    counts = [F.size(_of_rank(rank)).cast("long").alias(f"n_{kind}") for rank, (kind, *_) in enumerate(BASE)]
    tests = F.transform("secret_tests", lambda t: F.concat_ws(":", t["encoding"], t["start"], t["end"], F.format_string("%.12f", t["p"]), F.round(t["q"], 4)))
    return found.select(
        "doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secret_spans")).alias("spans"), F.array_join(tests, ",").alias("tests")
    )


def redact(found: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The rows of :func:`find_secrets` with every span of ``text`` replaced by ``mark``; overlapping spans count as one."""
    text = F.col("text")

    def step(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["at"]
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(apart, F.concat(acc["out"], F.array(gap, F.lit(mark)))).otherwise(acc["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    clean = F.aggregate(
        "secret_spans", start, step,
        lambda acc: F.array_join(F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, F.length(text)))), ""),
    )
    return found.withColumn("text", F.when(F.size("secret_spans") > 0, clean).otherwise(text)).drop("secret_spans", "secret_tests")


def redact_documents(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with the secrets in ``text`` replaced by ``mark``, all columns as they were, those of any name included."""
    packed = docs.select(F.struct(*docs.columns).alias("secret_row"), "text")
    clean = redact(find_secrets(packed), mark)
    return clean.select(*[F.col("text") if c == "text" else F.col("secret_row")[c].alias(c) for c in docs.columns])
