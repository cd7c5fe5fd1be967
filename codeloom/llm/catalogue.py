"""Registered queries of the problems on training text and code, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codeloom.llm import mixing, packing, provenance, quality, syntax, tokens
from codeloom.sources.tables import table


def _sources(spark: SparkSession, d: str) -> DataFrame:
    return syntax.with_language(table(spark, d, "source_files").select("file_id", "repo", "path", "content"), table(spark, d, "files"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.unparsable(_sources(spark, d)).select("file_id")


def p2_reasons(spark: SparkSession, d: str) -> DataFrame:
    return syntax.unparsable(_sources(spark, d)).select("file_id", "lang", "reason")


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    s = _sources(spark, d)
    return syntax.rates(s, syntax.unparsable(s))


def p3_scores(spark: SparkSession, d: str) -> DataFrame:
    info = table(spark, d, "files").where("file_id IS NOT NULL").groupBy("file_id").agg(F.max(F.struct("analyzed_at", "ingested_at", "size_bytes", "code_ratio")).alias("i")).select("file_id", "i.size_bytes", "i.code_ratio")
    files = table(spark, d, "source_files").select("file_id", "path", "content").join(info, "file_id", "left")
    return provenance.scored(files, table(spark, d, "library_files"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return provenance.not_hand_written(p3_scores(spark, d))


def _sizes(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return tokens.with_tokens(table(spark, d, "documents").select("doc_id", *more, "text"))


def _capacities(spark: SparkSession, d: str, most: int = 1000) -> dict:
    """Capacities by specification, a handful written by hand; more than most are an error."""
    got = table(spark, d, "pack_specs").where("spec_id IS NOT NULL AND capacity_tokens > 0").select("spec_id", "capacity_tokens").limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} packing specifications")
    return {r[0]: r[1] for r in got}


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_sizes(spark, d), _capacities(spark, d))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p6_packed(spark, d))


def p7_mixed(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_sizes(spark, d, "source", "lang"), table(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_sizes(spark, d, "source", "lang"), table(spark, d, "mix_targets"))[1]


def p8_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.statistics(table(spark, d, "documents"), table(spark, d, "common_words"))


def p8_counts(spark: SparkSession, d: str) -> DataFrame:
    """The figures that SQL can state."""
    s = p8_statistics(spark, d)
    share = lambda c: F.round(c, 9).alias(c)
    return s.select("doc_id", "n_chars", "n_words", "n_lines", share("mean_word_length"), share("common_words"), share("duplicate_lines"), "is_blank")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.not_prose(p8_statistics(spark, d))


_QUERIES = [p2_found, p2_reasons, p2_rates, p3_found, p3_scores, p6_packed, p6_fill, p7_mixed, p7_shares, p8_found, p8_statistics, p8_counts]


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


_P8_COUNTS = r"""
WITH d AS (SELECT doc_id, replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents),
c AS (SELECT DISTINCT lower(word) AS w FROM common_words WHERE word IS NOT NULL),
w AS (SELECT doc_id, unnest(regexp_extract_all(t, '[\p{L}\p{Nl}\p{No}]+(?:[''’][\p{L}\p{Nl}\p{No}]+)*|\p{Nd}+(?:[.,]\p{Nd}+)*')) AS w FROM d),
ws AS (SELECT doc_id, count(*) AS n, sum(length(w)) AS z, count(*) FILTER (WHERE lower(w) IN (SELECT w FROM c)) AS k FROM w GROUP BY doc_id),
l AS (SELECT doc_id, x, length(x) AS z FROM (SELECT doc_id, regexp_replace(unnest(string_split(t, chr(10))), '^[\s\p{Z}\x0b\x1c-\x1f\x85]+|[\s\p{Z}\x0b\x1c-\x1f\x85]+$', '', 'g') AS x FROM d) WHERE x <> ''),
g AS (SELECT doc_id, x, z, count(*) AS n FROM l GROUP BY ALL),
ls AS (SELECT doc_id, sum(n) AS n, sum(n * z) AS z, coalesce(sum(n * z) FILTER (WHERE n > 1), 0) AS k FROM g GROUP BY doc_id)
SELECT d.doc_id, length(t) AS n_chars, coalesce(ws.n, 0) AS n_words, CAST(coalesce(ls.n, 0) AS BIGINT) AS n_lines, round(coalesce(ws.z / ws.n, 0.0), 9) AS mean_word_length, round(coalesce(ws.k / ws.n, 0.0), 9) AS common_words,
  round(coalesce(ls.k / ls.z, 0.0), 9) AS duplicate_lines, ls.doc_id IS NULL AS is_blank
FROM d LEFT JOIN ws USING (doc_id) LEFT JOIN ls USING (doc_id)
""".replace("\\\\", "\\")


def oracle_sql() -> dict[str, str]:
    return {"p8_counts": _P8_COUNTS}
