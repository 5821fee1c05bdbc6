"""One query for each operator, over whole tables, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import chat, decontaminate, embeddings, licenses, line_dedup, mixing, phrases, pii, secret_scan, simhash, toxicity, url_filter, whitening
from tessera.llm.common import read

# The rules of op4 as (verdict, host, path), the conversation added by op7, and the demonstration key of op8.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
ADDED_CONVERSATION = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]
PSEUDONYM_KEY = b"replace this key in production"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = toxicity.low_quality_labels(read(spark, sf_dir, "labels"))
    return toxicity.judge_toxicity(read(spark, sf_dir, "documents"), labels)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_report(read(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, sf_dir, "documents"), licenses.registry(spark))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(read(spark, sf_dir, "pages"), url_filter.rules_frame(spark, URL_RULES))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicate_vectors(read(spark, sf_dir, "embeddings"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame(ADDED_CONVERSATION, "conv_id long, turn long, role string, text string")
    return chat.digest_examples(chat.format_examples(turns.unionByName(added)))


def op8_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(read(spark, sf_dir, "documents"), PSEUDONYM_KEY)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judge_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_secret_scan,
        op3_license_scan,
        op4_url_filter,
        op5_simhash,
        op6_embedding_dedup,
        op7_chat_format,
        op8_pii_pseudonyms,
        op9_decontamination,
        op10_mixing,
        op11_phrases,
        op12_embedding_whitening,
        op13_line_dedup,
    )
}

def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_UPPER_LOWER = f"'{url_filter.UPPER}', '{url_filter.LOWER}'"


def _canonical(text: str) -> str:
    out = f"translate(coalesce({text}, ''), {_UPPER_LOWER})"
    out = f"regexp_replace({out}, {_text(licenses.COPYRIGHT_LINE)}, '', 'g')"
    out = f"regexp_replace({out}, '[\\x00-\\x09\\x0B-\\x2F:-@\\[-`{{-\\x7F]+', ' ', 'g')"
    for pattern, replacement in licenses.EQUIVALENT:
        out = f"regexp_replace({out}, {_text(pattern)}, {_text(replacement.replace('$1', chr(92) + '1'))}, 'g')"
    return out


def _line(text: str) -> str:
    return f"trim(regexp_replace({text}, '[ \\n]+', ' ', 'g'))"


_KNOWN = " UNION ".join(
    f"SELECT {_text(name)} AS license, sha256({_line(_canonical(_text(text)))}) AS digest" for name, text in licenses.KNOWN
) + "".join(f" UNION SELECT {_text(name)}, {_text(digest)}" for name, _, digest in licenses.DIGESTS)
_ESCAPED = r"replace(replace(replace(text, '\', '\\'), '<turn:', '<\turn:'), '</turn>', '<\/turn>')"
_TURNS = rf"""SELECT *, sum(length('<turn:' || url_encode(role) || '>' || {_ESCAPED} || '</turn>') + 1) OVER (PARTITION BY conv_id ORDER BY rn) AS upto FROM (
 SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS rn, count(*) OVER (PARTITION BY conv_id) AS n FROM (
 SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok') u) t"""
_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
_GOOD = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"

ORACLE_SQL: dict[str, str] = {
    "op3_license_scan": f"""WITH known AS ({_KNOWN}), docs AS (SELECT doc_id, {_canonical('text')} AS normal FROM documents),
 units AS (SELECT doc_id, 0 AS part, {_line('normal')} AS unit FROM docs UNION ALL
 SELECT doc_id, 1, trim(regexp_replace(l, ' +', ' ', 'g')) FROM (SELECT doc_id, unnest(string_split(normal, chr(10))) AS l FROM docs) s)
 SELECT u.doc_id, min(k.license) FILTER (part = 0) AS license, coalesce(string_agg(DISTINCT k.license, ',' ORDER BY k.license), '') AS licenses,
 count(*) FILTER (part = 1 AND k.license IS NOT NULL) AS n_lines FROM units u LEFT JOIN known k ON k.digest = sha256(u.unit) GROUP BY u.doc_id""",
    "op4_url_filter": f"""WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
 p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), {_UPPER_LOWER}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
 fit AS (SELECT page_id, arg_max(rh || rp, length(rh) + length(rp)) AS rule, arg_max(v, length(rh) + length(rp)) AS verdict
 FROM p JOIN (VALUES {_RULES}) r(v, rh, rp) ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
 SELECT p.page_id, p.host, p.path, fit.rule, coalesce(fit.verdict, 'allow') AS verdict FROM p LEFT JOIN fit ON fit.page_id = p.page_id""",
    "op6_embedding_dedup": f"""WITH RECURSIVE good AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE {_GOOD}),
 links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
 WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)) >= 0.95),
 reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
 SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(c.c, e.vec_id)) AS component_id, e.vec_id <= coalesce(c.c, e.vec_id) AS kept
 FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = e.vec_id LEFT JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) c ON c.a = e.vec_id""",
    "op7_chat_format": f"""WITH t AS ({_TURNS})
 SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY rn) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(upto) FILTER (role = 'assistant' OR rn = n) AS BIGINT) AS formatted_chars FROM t GROUP BY conv_id""",
    "op13_line_dedup": f"""WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
 lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM cut),
 keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_UPPER_LOWER}) AS key FROM lines),
 shared AS (SELECT key, max(doc_id) AS keep FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
 marked AS (SELECT k.*, s.key IS NOT NULL AND s.keep <> k.doc_id AS gone FROM keyed k LEFT JOIN shared s ON s.key = k.key)
 SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
 FROM marked GROUP BY doc_id""",
    "op11_phrases": f"""WITH docs AS (SELECT coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), {_UPPER_LOWER}), '[.,;:!?\\x0A-\\x0D]') AS pieces FROM documents),
 pieces AS (SELECT lang, unnest(pieces) AS piece FROM docs),
 w AS MATERIALIZED (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
 n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
 f AS MATERIALIZED (SELECT lang, len, phrase, count(*) AS f FROM (
 SELECT lang, len, unnest(list_transform(range(1, len(w) - len + 2), lambda i: array_to_string(w[i:i + len - 1], ' '))) AS phrase
 FROM w CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS len) ls WHERE len(w) >= len) g GROUP BY lang, len, phrase HAVING count(*) >= 100),
 parts AS (SELECT lang, phrase, f AS a, k, array_to_string(ws[1:k], ' ') AS lp, array_to_string(ws[k + 1:], ' ') AS rp FROM (
 SELECT *, string_split(phrase, ' ') AS ws, unnest(range(1, len)) AS k FROM f WHERE len > 1) p),
 scored AS (SELECT p.lang, p.phrase, p.a, p.k, l.f AS l, r.f AS r, n.n, CAST(1000 * CAST(p.a AS HUGEINT) * n.n // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
 FROM parts p JOIN f l ON l.lang = p.lang AND l.phrase = p.lp JOIN f r ON r.lang = p.lang AND r.phrase = p.rp JOIN n ON n.lang = p.lang),
 best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
 kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM f o WHERE o.lang = b.lang AND o.len > len(string_split(b.phrase, ' ')) AND o.f >= b.a AND contains(' ' || o.phrase || ' ', ' ' || b.phrase || ' '))),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
 SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000""",
}
