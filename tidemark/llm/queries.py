"""The operators' registered queries: production parameters, whole tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import table

TOKENIZERS = os.environ.get("TIDEMARK_TOKENIZERS", "/opt/tokenizers")
LLM_QUERIES: dict = {}
LLM_ORACLES: dict[str, str] = {}


def tokenizer(name: str) -> str:
    """Path of a public vocabulary file, which every node has."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join(TOKENIZERS, name)


def query(f):
    LLM_QUERIES[f.__name__] = f
    return f


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


@query
def op1_secret_scan(spark, d):
    from tidemark.llm import secrets

    return secrets.scan(docs(spark, d))


@query
def op2_quality_rules(spark, d):
    from tidemark.llm import quality

    return quality.judge(docs(spark, d))


@query
def op3_fingerprints(spark, d):
    from tidemark.llm import fingerprint

    return fingerprint.edited_fingerprints(docs(spark, d))


@query
def op4_personal_data(spark, d):
    from tidemark.llm import pii

    return pii.find(docs(spark, d))


@query
def op5_packing(spark, d):
    from tidemark.llm import packing

    return packing.pack(docs(spark, d), tokenizer("word_bpe_49k.json"))


@query
def op6_line_dedup(spark, d):
    from tidemark.llm import lines

    return lines.dedup(docs(spark, d).select("doc_id", "text"), counts=True)


@query
def op7_near_dedup(spark, d):
    from tidemark.llm import neardup

    return neardup.classes(docs(spark, d))


@query
def op8_language_id(spark, d):
    from tidemark.llm import langid

    return langid.identify(docs(spark, d))


@query
def op9_piece_codec(spark, d):
    from tidemark.llm import piece_codec

    return piece_codec.digests(docs(spark, d), tokenizer("piece_bpe_32k.model"))


@query
def op10_token_files(spark, d):
    from tidemark.llm import token_files

    return token_files.token_files(docs(spark, d), tokenizer("word_bpe_49k.json"))


# The columns that the contract fixes and SQL can express, through the same operators, beside their SQL.

_T = "t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents)"
_WORDS = r"list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LINES = r"list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))"
_DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"


def fixed(sql: str):
    def register(f):
        LLM_ORACLES[f.__name__] = sql
        return query(f)

    return register


@fixed(
    rf"""WITH {_T}, w AS (SELECT *, {_WORDS} AS w, {_LINES} AS l FROM t),
    g AS (SELECT rid, i, array_to_string(list_slice(w, i, i + 7), ' ') AS win FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 7)) AS i FROM w WHERE len(w) >= 8)),
    again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM g) WHERE n > 1),
    hit AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(generate_series(i, i + 7)) AS p FROM again) GROUP BY rid),
    c AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[ 	-
]+', '', 'g')) AS BIGINT) AS word_chars,
      CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(hit.n, 0) AS n_repeat_words
      FROM w LEFT JOIN hit USING (rid))
    SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c"""
)
def fixed_quality(spark, d):
    """The counts and the base rule of the quality rules."""
    return op2_quality_rules(spark, d).drop("kept")


@fixed(
    rf"""WITH {_T} SELECT doc_id, CAST(len(list_filter(regexp_extract_all(text, '(?i:password|passwd|secret|token|api_?key)["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 6)) AS BIGINT) AS n_assign,
    CAST(len(list_filter(regexp_extract_all(text, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS BIGINT) AS n_access,
    CAST(len(list_filter(regexp_extract_all(text, '[0-9a-f]+'), lambda x: length(x) >= 24)) AS BIGINT) AS n_hex FROM t"""
)
def fixed_secrets(spark, d):
    """The pattern counts of the secret scan."""
    return op1_secret_scan(spark, d).select("doc_id", "n_assign", "n_access", "n_hex")


@fixed(
    f"""WITH {_T}, n AS (SELECT doc_id, text, length(text) AS n, coalesce(lead(text) OVER o, first_value(text) OVER o) AS nxt FROM t WINDOW o AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
    SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(substring(text, 1, n - n // 2) || substring(nxt, 1, n // 2)) AS edited_sha256 FROM n"""
)
def fixed_fingerprints(spark, d):
    """Lengths and edited texts of the fingerprints."""
    return op3_fingerprints(spark, d).select("doc_id", "n_chars", "edited_sha256")


@fixed(
    rf"""WITH {_T} SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')) AS BIGINT) AS n_email,
    CAST(len(list_filter(regexp_extract_all(text, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'), lambda x: list_bool_and(list_transform(string_split(x, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND CAST('0' || right(ltrim(p, '0'), 3) AS INTEGER) <= 255)))) AS BIGINT) AS n_ip,
    CAST(len(list_filter(regexp_extract_all(text, '[0-9](?:[ -]?[0-9])+'), lambda x: length({_DIGITS}) BETWEEN 14 AND 19 AND
      list_sum(list_transform(string_split(reverse({_DIGITS}), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN CAST(c AS INTEGER) WHEN CAST(c AS INTEGER) > 4 THEN 2 * CAST(c AS INTEGER) - 9 ELSE 2 * CAST(c AS INTEGER) END)) % 10 = 0)) AS BIGINT) AS n_card,
    CAST(len(list_filter(regexp_extract_all(text, '\+[0-9][ ().0-9-]+[0-9]'), lambda x: length({_DIGITS}) BETWEEN 10 AND 15)) AS BIGINT) AS n_phone FROM t"""
)
def fixed_personal_data(spark, d):
    """The pattern counts of the personal data."""
    return op4_personal_data(spark, d).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")
