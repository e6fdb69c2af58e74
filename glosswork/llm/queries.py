"""Queries of the operators for training text, and SQL where it can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.llm import embedded, formatdup, handwritten, lang, leaks, mixing, parsing, sampling, sentences
from glosswork.plans.common import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return lang.languages(table(spark, d, "comments")).where("mended AND lang != 'und'").select("comment_id", "seg_no", "lang")


def p1_languages(spark: SparkSession, d: str) -> DataFrame:
    return lang.languages(table(spark, d, "comments")).withColumn("confidence", F.round("confidence", 4))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.classified(table(spark, d, "source_files")).where("kind IS NOT NULL").select("file_id")


def p2_kinds(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.classified(table(spark, d, "source_files"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return parsing.parse(table(spark, d, "source_files")).where("NOT valid").select("file_id")


def p3_errors(spark: SparkSession, d: str) -> DataFrame:
    return parsing.parse(table(spark, d, "source_files"))


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    return parsing.rates(parsing.parse(table(spark, d, "source_files")))


def p3_filled(spark: SparkSession, d: str) -> DataFrame:
    return parsing.filled(table(spark, d, "extract_stats"), parsing.parse(table(spark, d, "source_files")), table(spark, d, "manifest"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return sampling.allocate(table(spark, d, "pool"), table(spark, d, "sample_targets")).where("short > 0").select("source", "lang", "band")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return sampling.allocate(table(spark, d, "pool"), table(spark, d, "sample_targets")).select("source", "lang", "band", "need", "available", "short", "allocated", "unmet")


def p4_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.draw(table(spark, d, "pool"), table(spark, d, "sample_targets"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return formatdup.copies(table(spark, d, "comments").where("exclude IS NULL"))[1]


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    return formatdup.collapse(table(spark, d, "comments").where("exclude IS NULL"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return embedded.embedded(table(spark, d, "comments")).select("comment_id", "place", "lang")


def p6_shares(spark: SparkSession, d: str) -> DataFrame:
    return embedded.shares(table(spark, d, "comments"), table(spark, d, "source_files"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    hits = leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return hits.select(F.col("id").alias("doc_id"), "item_id").distinct()


def p7_cleaned(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    hits = leaks.leaks(docs, table(spark, d, "eval_items"))
    return leaks.without_leaks(docs, hits).select("doc_id", "text", "removed_chars")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    _, report = mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    return report.where("short").select("source")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_languages, p2_found, p2_kinds, p3_found, p3_errors, p3_rates, p3_filled, p4_found, p4_report, p4_sample, p5_found, p5_records, p6_found, p6_shares, p7_found, p7_cleaned, p8_found, p8_report, p9_found)
}

NEEDS = """
WITH m AS (
  SELECT DISTINCT id, source, lower(trim(lang)) AS lang,
    CASE WHEN overlap IS NULL OR isnan(overlap) THEN 'none' WHEN overlap < 0.25 THEN 'low' WHEN overlap < 0.5 THEN 'mid' ELSE 'high' END AS band
  FROM pool WHERE id IS NOT NULL
), n AS (SELECT count(DISTINCT id) // 5 AS n FROM m),
h AS (SELECT source, lang, band, count(*) AS available FROM m GROUP BY ALL),
c AS (
  SELECT t.source, t.lang, t.band, coalesce(h.available, 0) AS available,
    greatest(t.min_rows, floor(t.target_share::DECIMAL(12, 6) * n.n + 0.5)::BIGINT) AS need
  FROM sample_targets t CROSS JOIN n LEFT JOIN h ON h.source = t.source AND h.lang = t.lang AND h.band = t.band
)
"""

_TREE = ("source", "lang", "band")


def _passed_on(name: str, before: str, group: tuple[str, ...]) -> str:
    part = f"PARTITION BY {', '.join(group)}" if group else ""
    order = f"{part} ORDER BY {', '.join(_TREE)} ROWS"
    return f"""{name}w AS (SELECT *, sum(lack) OVER ({part}) AS ls, sum(spare) OVER ({part}) AS ss, coalesce(sum(spare) OVER ({order} BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sb, sum(lack) OVER ({order} UNBOUNDED PRECEDING) AS lu FROM {before}),
{name} AS (SELECT source, lang, band, need, available, short, allocated + greatest(0, least(spare, ls - sb)) AS allocated, spare - greatest(0, least(spare, ls - sb)) AS spare, least(lack, greatest(0, lu - ss)) AS lack FROM {name}w)"""


_CANON = r"""WITH t AS (SELECT comment_id, repo, text, regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g') AS plain, regexp_matches(text, '(?:^|[\s\p{Z};])(?:@[\p{L}\p{M}\p{N}_.-]+[\s\p{Z}]+[^\s\p{Z}]|[\p{L}\p{M}\p{N}_.-]+=[^\s\p{Z}])') AS fields,
  list_sort(list_filter(list_transform(string_split_regex(replace(text, '@', chr(2) || '@'), '\r\n|[\n\r\x0b\x0c\x02;]|\x{85}|\x{2028}|\x{2029}'), lambda x: regexp_replace(lower(x), '[^\p{L}\p{N}]+', '', 'g')), lambda x: x != '')) AS pieces FROM comments WHERE exclude IS NULL AND repo IS NOT NULL),
c AS (SELECT comment_id, repo, CASE WHEN fields THEN array_to_string(pieces, chr(1)) ELSE plain END AS c FROM t)
"""
_GRAMS = r"""list_filter(list_transform(string_split_regex(lower(text), '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+'), lambda x: regexp_replace(x, '[^\p{L}\p{N}]', '', 'g')), lambda x: x != '')"""

SQL: dict[str, str] = {
    "p4_found": NEEDS + "SELECT source, lang, band FROM c WHERE available < need",
    "p4_report": NEEDS.rstrip() + ", s AS (SELECT *, greatest(0, need - available) AS short, least(need, available) AS allocated, greatest(0, available - need) AS spare, greatest(0, need - available) AS lack FROM c),\n"
    + ",\n".join((_passed_on("a", "s", ("source", "lang")), _passed_on("b", "a", ("source",)), _passed_on("d", "b", ())))
    + "\nSELECT source, lang, band, need::BIGINT AS need, available::BIGINT AS available, short::BIGINT AS short, allocated::BIGINT AS allocated, lack::BIGINT AS unmet FROM d",
    "p5_found": _CANON + "SELECT * FROM (SELECT min(comment_id) OVER (PARTITION BY repo, c) AS keep_id, comment_id AS copy_id FROM c WHERE c != '') WHERE keep_id != copy_id",
    "p5_records": _CANON + "SELECT min(comment_id) AS keep_id, count(*) AS n FROM c WHERE c != '' GROUP BY repo, c",
    "p7_found": f"""WITH d AS (SELECT doc_id, {_GRAMS} AS w FROM documents), i AS (SELECT item_id, {_GRAMS} AS w FROM eval_items),
dg AS (SELECT doc_id, array_to_string(w[k:k + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d)), ig AS (SELECT item_id, array_to_string(w[k:k + 12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS k FROM i))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
}
