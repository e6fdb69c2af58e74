"""All queries of the core by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.functions import text as T
from glosswork.operators import aggregates, pool, stats
from glosswork.plans.common import table


def _pool(spark: SparkSession, d: str) -> DataFrame:
    """Each pool id once, with its language in one spelling."""
    rows = table(spark, d, "pool").select("id", "source", F.lower(F.trim("lang")).alias("lang"), "kind", "repo", "overlap", "cue", "cls")
    return rows.distinct()


def _fates(spark: SparkSession, d: str) -> DataFrame:
    return pool.fates(table(spark, d, "comments"))


def _kept(spark: SparkSession, d: str) -> DataFrame:
    return _fates(spark, d).where("fate = 'kept'").drop("fate")


def function_mix(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.function_mix(_pool(spark, d), "source")


def function_mix_by_lang(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.function_mix(_pool(spark, d), "source", "lang")


def overlap_histogram(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.histogram(_pool(spark, d))


def overlap_describe(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.describe(_pool(spark, d), "overlap", "source")


def overlap_mass_points(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.mass_points(_pool(spark, d))


def sensitivity_curve(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.sensitivity(_pool(spark, d))


def kind_counts(spark: SparkSession, d: str) -> DataFrame:
    return _pool(spark, d).groupBy("source", "lang", "kind").agg(F.count("*").alias("n"))


def overlap_rank_test(spark: SparkSession, d: str) -> DataFrame:
    return stats.mann_whitney(_pool(spark, d), "overlap", "source", "ai", "human")


def class_contingency(spark: SparkSession, d: str) -> DataFrame:
    return stats.chi2(_pool(spark, d), "source", "cls")


def density_by_source(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.density(table(spark, d, "file_stats"), "source")


def density_by_lang(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.density(table(spark, d, "file_stats"), "source", "lang")


def drop_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _fates(spark, d).groupBy("source", "fate").agg(F.count("*").alias("n"))


def deduplicated(spark: SparkSession, d: str) -> DataFrame:
    return _kept(spark, d).select("comment_id")


def repos_with_enough(spark: SparkSession, d: str) -> DataFrame:
    return pool.at_least(_kept(spark, d), ["source", "repo"], 5).groupBy("source", "repo").agg(F.count("*").alias("n"))


def capped_per_repo(spark: SparkSession, d: str) -> DataFrame:
    return pool.capped(_kept(spark, d), ["repo"], 20, 2026).select("comment_id", "repo")


def comment_origin(spark: SparkSession, d: str) -> DataFrame:
    return pool.attribution(table(spark, d, "comments"), table(spark, d, "manifest")).groupBy("origin").agg(F.count("*").alias("n"))


def comment_overlap(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "comments").where("exclude IS NULL")
    return rows.select("comment_id", F.round(T.overlap(F.col("text"), F.col("code")), 6).alias("overlap")).where("overlap IS NOT NULL")


def word_counts(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.word_counts(table(spark, d, "comments").where("exclude IS NULL"))


def word_pairs(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.bigrams(table(spark, d, "comments").where("exclude IS NULL"))


def distinctive_words(spark: SparkSession, d: str) -> DataFrame:
    return stats.log_odds(word_counts(spark, d), "ai", "human")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        function_mix, function_mix_by_lang, overlap_histogram, overlap_describe, overlap_mass_points, sensitivity_curve, kind_counts, overlap_rank_test, class_contingency,
        density_by_source, density_by_lang, drop_reasons, deduplicated, repos_with_enough, capped_per_repo, comment_origin, comment_overlap, word_counts, word_pairs, distinctive_words,
    )
}

_P = "WITH p AS (SELECT DISTINCT id, source, lower(trim(lang)) AS lang, kind, repo, overlap, cue, cls FROM pool)\n"
_MIX = """count(*) AS n, count(cls) AS classified, count(*) - count(cls) AS undecided,
  count(*) FILTER (cls = 'explanatory') AS explanatory, count(*) FILTER (cls = 'referential') AS referential, count(*) FILTER (cls = 'other') AS other,
  round(count(*) FILTER (cls = 'explanatory') / nullif(count(cls), 0), 6) AS share_explanatory,
  round(count(*) FILTER (cls = 'referential') / nullif(count(cls), 0), 6) AS share_referential,
  round(count(*) FILTER (cls = 'other') / nullif(count(cls), 0), 6) AS share_other FROM p """
_DENSITY = """WITH f AS (SELECT DISTINCT source, lang, repo, sha, file, added_lines, added_nonblank, comments, comment_lines FROM file_stats),
r AS (SELECT {by}, repo, sum(added_lines) AS al, sum(added_nonblank) AS an, sum(comments) AS c, sum(comment_lines) AS cl FROM f GROUP BY {by}, repo)
SELECT {by}, count(*) AS repos, round(sum(c) * 100.0 / nullif(sum(al), 0), 6) AS per100, round(sum(c) * 100.0 / nullif(sum(an), 0), 6) AS per100_nonblank,
  round(sum(cl) / nullif(sum(al), 0), 6) AS line_share, round(quantile_cont(c * 100.0 / nullif(al, 0), 0.5), 6) AS median_per100 FROM r GROUP BY {by}"""
_STOP = "['" + "', '".join(w.replace("'", "''") for w in T.STOPWORDS) + "']"
# RE2 knows no look-behind: the character before an issue number is matched and put back; a second pass takes numbers that touch.
_URLS = r"regexp_replace(text, 'https?://\S+|www\.\S+', ' ', 'g')"
_ISSUE = r"regexp_replace({}, '(^|[^\w&])#\d{{1,7}}\b', '\1 ', 'g')"
_REFS = rf"regexp_replace({_ISSUE.format(_ISSUE.format(_URLS))}, '\b[A-Z][A-Z0-9]+-\d+\b|\b(?:gh|GH)-\d+\b', ' ', 'g')"
_WORDS = rf"list_filter(list_transform(regexp_extract_all(lower(translate({_REFS}, '‘’“”', '''''""')), '[a-z][a-z0-9'']*'), lambda w: regexp_replace(w, '''s$', '')), lambda w: length(w) >= 2)"


def _ids(text: str) -> str:
    apart = rf"regexp_replace(regexp_replace(i, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '([A-Z])([A-Z][a-z])', '\1_\2', 'g')"
    return rf"list_filter(flatten(list_transform(regexp_extract_all({text}, '[A-Za-z_][A-Za-z0-9_]*'), lambda i: string_split(lower({apart}), '_'))), lambda w: length(w) >= 2 AND NOT regexp_matches(w, '^[0-9]+$'))"


_FATES = rf"""WITH w AS (SELECT *, {_WORDS} AS words, trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')) AS k FROM comments),
e AS (SELECT *, length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS ascii_ones,
  len(list_filter(words, lambda w: list_contains({_STOP}, w))) AS stops FROM w),
g AS (SELECT *, CASE WHEN exclude IS NOT NULL THEN 'excluded_' || exclude
  WHEN NOT coalesce(letters > 0 AND ascii_ones * 10 >= letters * 9 AND (len(words) < 6 OR stops >= 0.12 * len(words)), false) THEN 'non_english' END AS early FROM e),
b AS (SELECT comment_id, source, repo, lang, kind, coalesce(early, CASE WHEN k != '' AND row_number() OVER (PARTITION BY early IS NULL, source, repo, k ORDER BY comment_id) = 1 THEN 'kept' ELSE 'duplicate' END) AS fate FROM g)
"""
_COUNTS = f"""WITH t AS (SELECT source, unnest({_WORDS}) AS word FROM comments WHERE exclude IS NULL),
c AS (SELECT source, word, count(*) AS k FROM t WHERE length(word) >= 3 AND NOT list_contains({_STOP}, word) GROUP BY ALL)
"""

SQL: dict[str, str] = {
    "function_mix": _P + "SELECT source, " + _MIX + "GROUP BY source",
    "function_mix_by_lang": _P + "SELECT source, lang, " + _MIX + "GROUP BY source, lang",
    "overlap_histogram": _P + """, h AS (SELECT source, least(floor(overlap * 100 + 1e-9)::INT, 99) AS bin, count(*) AS n, count(*) FILTER (NOT cue) AS n_nocue FROM p WHERE overlap IS NOT NULL GROUP BY ALL)
SELECT s.source, b.bin::INT AS bin, coalesce(h.n, 0) AS n, coalesce(h.n_nocue, 0) AS n_nocue FROM (SELECT DISTINCT source FROM p) s CROSS JOIN range(100) b(bin) LEFT JOIN h ON h.source = s.source AND h.bin = b.bin""",
    "overlap_describe": _P + """SELECT source, count(*) AS n, round(avg(overlap), 6) AS mean, round(quantile_cont(overlap, 0.25), 6) AS q1, round(quantile_cont(overlap, 0.5), 6) AS median,
  round(quantile_cont(overlap, 0.75), 6) AS q3 FROM p WHERE overlap IS NOT NULL GROUP BY source""",
    "overlap_mass_points": _P + """, c AS (SELECT source, round(overlap, 4) AS value, count(*) AS k FROM p WHERE overlap IS NOT NULL GROUP BY ALL)
SELECT source, value, k, (row_number() OVER (PARTITION BY source ORDER BY k DESC, value))::INT AS rank, round(k / sum(k) OVER (PARTITION BY source), 6) AS share FROM c QUALIFY rank <= 4""",
    "sensitivity_curve": _P + """SELECT source, t::INT AS theta, round(count(*) FILTER (NOT cue AND overlap >= t / 100 - 1e-12) / count(*), 6) AS share
FROM p CROSS JOIN range(20, 81, 5) g(t) WHERE cls IS NOT NULL GROUP BY ALL""",
    "kind_counts": _P + "SELECT source, lang, kind, count(*) AS n FROM p GROUP BY ALL",
    "overlap_rank_test": _P + """, v AS (SELECT *, rank() OVER (ORDER BY overlap) + (count(*) OVER (PARTITION BY overlap) - 1) / 2 AS r, count(*) OVER (PARTITION BY overlap) AS t
  FROM p WHERE overlap IS NOT NULL AND source IN ('ai', 'human')),
s AS (SELECT count(*) FILTER (source = 'ai') AS n1, count(*) FILTER (source = 'human') AS n2, sum(r) FILTER (source = 'ai') AS r, sum(t::DOUBLE * t - 1) AS ties FROM v),
u AS (SELECT *, r - n1 * (n1 + 1) / 2 AS u, n1::DOUBLE * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2)::DOUBLE * (n1 + n2 - 1))) AS var FROM s)
SELECT n1, n2, u, round(sign(u - n1 * n2 / 2) * greatest(abs(u - n1 * n2 / 2) - 0.5, 0) / sqrt(var), 6) AS z, round(2 * u / (n1 * n2) - 1, 6) AS delta FROM u""",
    "class_contingency": _P + """, q AS (SELECT source AS a, cls AS b FROM p WHERE source IS NOT NULL AND cls IS NOT NULL), n AS (SELECT count(*)::DOUBLE AS n FROM q),
r AS (SELECT a, count(*) AS ka FROM q GROUP BY a), c AS (SELECT b, count(*) AS kb FROM q GROUP BY b), o AS (SELECT a, b, count(*) AS k FROM q GROUP BY a, b),
x AS (SELECT sum((coalesce(k, 0) - ka * kb / n) ** 2 / (ka * kb / n)) AS x, any_value(n) AS n, count(DISTINCT r.a) AS na, count(DISTINCT c.b) AS nb FROM r CROSS JOIN c CROSS JOIN n LEFT JOIN o ON o.a = r.a AND o.b = c.b)
SELECT n::BIGINT AS n, round(x, 6) AS chi2, (na - 1) * (nb - 1) AS df, round(sqrt(x / (n * (least(na, nb) - 1))), 6) AS cramers_v FROM x""",
    "density_by_source": _DENSITY.format(by="source"),
    "density_by_lang": _DENSITY.format(by="source, lang"),
    "drop_reasons": _FATES + "SELECT source, fate, count(*) AS n FROM b GROUP BY ALL",
    "deduplicated": _FATES + "SELECT comment_id FROM b WHERE fate = 'kept'",
    "repos_with_enough": _FATES + "SELECT source, repo, count(*) AS n FROM b WHERE fate = 'kept' GROUP BY ALL HAVING count(*) >= 5",
    "capped_per_repo": _FATES + "SELECT comment_id, repo FROM b WHERE fate = 'kept' QUALIFY row_number() OVER (PARTITION BY repo ORDER BY md5('2026:' || comment_id), comment_id) <= 20",
    "comment_origin": """WITH m AS (SELECT repo, sha, file, arg_max(added_ranges, ingested_at) AS ranges FROM manifest GROUP BY ALL),
l AS (SELECT DISTINCT repo, sha, file, unnest(range(r[1], r[2] + 1)) AS line FROM (SELECT repo, sha, file, unnest(ranges) AS r FROM m)),
c AS (SELECT c.comment_id, any_value(c.end_line - c.start_line + 1) AS size, count(l.line) AS hit, any_value(m.file) AS listed, bool_or(m.ranges IS NULL) AS whole
  FROM comments c LEFT JOIN m USING (repo, sha, file) LEFT JOIN l ON l.repo = c.repo AND l.sha = c.sha AND l.file = c.file AND l.line BETWEEN c.start_line AND c.end_line GROUP BY c.comment_id)
SELECT CASE WHEN listed IS NULL THEN NULL WHEN whole OR hit = size THEN 'all' WHEN hit > 0 THEN 'mixed' ELSE 'none' END AS origin, count(*) AS n FROM c GROUP BY ALL""",
    "comment_overlap": f"""WITH w AS (SELECT comment_id, list_filter(list_distinct({_ids(_REFS)}), lambda w: NOT list_contains({_STOP}, w)) AS c, list_distinct({_ids("code")}) AS k FROM comments WHERE exclude IS NULL)
SELECT comment_id, round(len(list_intersect(c, k)) / len(c), 6) AS overlap FROM w WHERE len(c) >= 3 AND len(k) > 0""",
    "word_counts": _COUNTS + "SELECT source, word, k FROM c",
    "word_pairs": f"""WITH t AS (SELECT source, {_WORDS} AS w FROM comments WHERE exclude IS NULL), e AS (SELECT source, w, unnest(range(1, len(w))) AS i FROM t),
p AS (SELECT source, w[i] AS a, w[i + 1] AS b FROM e), c AS (SELECT source, a || ' ' || b AS pair, count(*) AS k FROM p
  WHERE length(a) >= 3 AND length(b) >= 3 AND NOT list_contains({_STOP}, a) AND NOT list_contains({_STOP}, b) GROUP BY ALL)
SELECT source, pair, k, (row_number() OVER (PARTITION BY source ORDER BY k DESC, pair))::INT AS rank FROM c QUALIFY rank <= 25""",
    "distinctive_words": _COUNTS + """, w AS (SELECT word, coalesce(sum(k) FILTER (source = 'ai'), 0)::BIGINT AS ka, coalesce(sum(k) FILTER (source = 'human'), 0)::BIGINT AS kb FROM c WHERE source IN ('ai', 'human') GROUP BY word),
n AS (SELECT sum(ka)::DOUBLE AS na, sum(kb)::DOUBLE AS nb FROM w), q AS (SELECT *, 500.0::DOUBLE * (ka + kb) / (na + nb) AS p FROM w CROSS JOIN n WHERE ka + kb >= 10)
SELECT word, ka, kb, round((ln((ka + p) / (na + 500 - ka - p)) - ln((kb + p) / (nb + 500 - kb - p))) / sqrt(1 / (ka + p) + 1 / (kb + p)), 6) AS z FROM q""",
}
