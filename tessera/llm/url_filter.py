"""URL filter: host-suffix and path-prefix expressions, joined to rules on short hash prefixes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters (hex digits) of the digest that the equi-join compares; the full digest is confirmed after it.
PREFIX_DIGITS = 8
#: Rule tables of at most so many rows are broadcast; larger ones are shuffled.
BROADCAST_RULES = 100_000


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """Host after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """Path after the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_frame(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rules ``(verdict, host, path)`` as a table."""
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Judge every row of ``pages(page_id, url)`` by ``rules(verdict, host, path)``.

    A rule fits its host and all subdomains if the url's path starts with the rule's. The longest
    fitting rule (host and path together, then host) wins; of equal rules with different verdicts,
    ``block``. Without a fitting rule the verdict is ``default``. Returns page_id, host, path,
    rule (``host`` + ``path``, else null) and verdict, one row for each row of ``pages``.

    Each *distinct* url is expanded once into the host suffixes with a rule's number of labels times
    the path prefixes with a rule's length; other expressions can equal no rule. Expressions and
    rules meet on the first hex digits of their digests, then the full digests and the texts are
    compared. Null urls and urls without ``://`` have an empty host and path and fit no rule unless
    a rule has an empty host. Other columns of ``pages`` are ignored.
    """
    pages = pages.select("page_id", "url")
    known = (
        rules.groupBy(F.translate("host", UPPER, LOWER).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"))
        .agg(F.max("verdict").alias("r_verdict"))
        .withColumn("r_digest", F.sha2(F.concat("r_host", "r_path"), 256))
        .withColumn("r_key", F.substring("r_digest", 1, PREFIX_DIGITS))
    )
    shape = rules.agg(
        F.count("*").alias("n"),
        F.collect_set(F.length(F.coalesce("path", F.lit("")))).alias("lengths"),
        F.collect_set(F.size(F.split("host", r"\."))).alias("labels"),
    ).first()  # distinct lengths and label counts: bounded by the longest rule
    lengths = F.array(*[F.lit(n) for n in sorted(shape["lengths"])]).cast("array<int>")
    depths = F.array(*[F.lit(n) for n in sorted(shape["labels"])]).cast("array<int>")
    if shape["n"] <= BROADCAST_RULES:
        known = F.broadcast(known)

    urls = pages.where("url is not null").select("url").distinct()
    parts = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.filter(depths, lambda n: n <= F.size(labels)),
        lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."),
    )
    prefixes = F.transform(
        F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n)
    )
    expressions = (
        parts.select("url", F.explode(suffixes).alias("e_host"), prefixes.alias("prefixes"))
        .select("url", "e_host", F.explode("prefixes").alias("e_path"))
        .withColumn("e_digest", F.sha2(F.concat("e_host", "e_path"), 256))
        .withColumn("e_key", F.substring("e_digest", 1, PREFIX_DIGITS))
    )
    hits = expressions.join(
        known,
        (F.col("e_key") == F.col("r_key"))
        & (F.col("e_digest") == F.col("r_digest"))
        & (F.col("e_host") == F.col("r_host"))
        & (F.col("e_path") == F.col("r_path")),
    )
    best = hits.groupBy("url").agg(
        F.max_by(
            F.struct(F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict")),
            F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host"), "r_verdict"),
        ).alias("best")
    )
    return pages.join(best, "url", "left").select(
        "page_id",
        host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"),
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
