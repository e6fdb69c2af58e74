"""Queries that set two corpora beside each other, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.functions import features, lexicon, tails
from glosswork.operators import aggregates, comparison, extraction, sampling, stats
from glosswork.plans.common import table
from glosswork.sources import usable


def _pool(spark: SparkSession, d: str) -> DataFrame:
    """Each pool id once, with its texts."""
    return table(spark, d, "pool").select("id", "source", F.lower(F.trim("lang")).alias("lang"), "kind", "repo", "overlap", "cue", "cls", "text", "code", "line").distinct()


def _judged(spark: SparkSession, d: str) -> DataFrame:
    """The pool's classes as the truth, and what the rule says."""
    return _pool(spark, d).select("overlap", "cue", F.col("cls").alias("truth"), features.rule_label(F.round("overlap", 5), F.col("cue")).alias("rule"))


def marker_comparison(spark: SparkSession, d: str) -> DataFrame:
    return comparison.compared(comparison.presence(comparison.labelled(sampling.without_docs(_pool(spark, d))), list(lexicon.MARKERS)))


def marker_groups(spark: SparkSession, d: str) -> DataFrame:
    groups = spark.createDataFrame([(c, g) for g, cs in lexicon.GROUPS.items() for c in cs.split()], "label string, grp string")
    rows = comparison.labelled(sampling.without_docs(_pool(spark, d))).select("source", "id", F.explode("labels").alias("label"))
    named = rows.join(F.broadcast(groups), "label", "left").select("source", "id", F.coalesce("grp", "label").alias("grp")).distinct()  # as many rows as categories
    return named.groupBy("source", "grp").agg(F.count("*").alias("comments"))


def cue_agreement(spark: SparkSession, d: str) -> DataFrame:
    return _pool(spark, d).groupBy("source", "cue", features.has_cue(F.col("text")).alias("computed")).agg(F.count("*").alias("n"))


def idiom_rates(spark: SparkSession, d: str) -> DataFrame:
    return comparison.idiom_rates(sampling.without_docs(_pool(spark, d)))


def style_means(spark: SparkSession, d: str) -> DataFrame:
    return comparison.style(sampling.without_docs(_pool(spark, d)))


def documentation_block(spark: SparkSession, d: str) -> DataFrame:
    return comparison.documentation(_pool(spark, d)).select("source", "n", "classified", "share_referential", "mean_overlap", "third_person")


def rule_confusion(spark: SparkSession, d: str) -> DataFrame:
    return comparison.confusion(_judged(spark, d))


def rule_scores(spark: SparkSession, d: str) -> DataFrame:
    return comparison.scores(_judged(spark, d))


def threshold_scan(spark: SparkSession, d: str) -> DataFrame:
    return comparison.theta_scan(_judged(spark, d))


def rule_kappa(spark: SparkSession, d: str) -> DataFrame:
    return comparison.kappa(_judged(spark, d), "truth", "rule")


def _by_repo(spark: SparkSession, d: str) -> DataFrame:
    rows = _pool(spark, d).where("cls IS NOT NULL")
    return rows.groupBy(F.col("source").alias("side"), F.col("repo").alias("cluster")).agg(F.count_if(F.col("cls") == "explanatory").alias("num"), F.count("*").alias("den"))


def explanatory_interval(spark: SparkSession, d: str) -> DataFrame:
    return comparison.bootstrap(_by_repo(spark, d))


def density_ratio_interval(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "file_stats").select("source", "repo", "sha", "file", "comments", "added_lines").distinct()
    return comparison.bootstrap(rows.groupBy(F.col("source").alias("side"), F.col("repo").alias("cluster")).agg(F.sum("comments").alias("num"), F.sum("added_lines").alias("den")), ratio=True)


def balanced_languages(spark: SparkSession, d: str) -> DataFrame:
    return sampling.balanced(_pool(spark, d).select("id", "source", "lang"), "lang", "source", "ai", "human", 7)


def blind_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.blind_sample(_pool(spark, d), 120, 7)


def pair_examples(spark: SparkSession, d: str) -> DataFrame:
    return sampling.examples(_pool(spark, d), seed=7).drop("code")


def eligible_repos(spark: SparkSession, d: str) -> DataFrame:
    return sampling.eligible_repos(table(spark, d, "repo_meta"), "2024-01-01", 200_000)


def language_quotas(spark: SparkSession, d: str) -> DataFrame:
    return sampling.quotas(table(spark, d, "repo_meta").select("full_name", "language").distinct(), "language", 100)


def revisions_in_budget(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "manifest").groupBy("repo", "sha", "file").agg(F.max("size").alias("size"))
    return sampling.within_budget(rows, "repo", ["sha", "file"], "size", 20_000, 7).select("repo", "sha", "file")


def referential_curve(spark: SparkSession, d: str) -> DataFrame:
    rows = _pool(spark, d)
    return comparison.referential_curve(aggregates.histogram(rows), rows.where("cls IS NOT NULL").groupBy("source").agg(F.count("*").alias("classified")))


def curve_steps(spark: SparkSession, d: str) -> DataFrame:
    return comparison.steps(referential_curve(spark, d), 0.05)


def curve_crossings(spark: SparkSession, d: str) -> DataFrame:
    return comparison.crossings(referential_curve(spark, d))


def coarse_histogram(spark: SparkSession, d: str) -> DataFrame:
    return comparison.rebinned(aggregates.histogram(_pool(spark, d)))


def group_sizes(spark: SparkSession, d: str) -> DataFrame:
    return comparison.small_groups(_pool(spark, d))


def restating_comments(spark: SparkSession, d: str) -> DataFrame:
    return comparison.flagged(table(spark, d, "pool")).select("id", "repo", "line", "overlap").distinct()


def comment_blocks(spark: SparkSession, d: str) -> DataFrame:
    return extraction.line_comments(table(spark, d, "source_files"))


def exclusion_reasons(spark: SparkSession, d: str) -> DataFrame:
    return extraction.reasons(table(spark, d, "comments"))


def extraction_counts(spark: SparkSession, d: str) -> DataFrame:
    return extraction.counters(table(spark, d, "comments"), table(spark, d, "manifest"))


def file_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = extraction.file_rows(table(spark, d, "source_files"), table(spark, d, "manifest"), table(spark, d, "comments"))
    return rows.select("repo", "sha", "file", "source", "added_lines", "added_nonblank", "comments", "comment_lines", F.coalesce(F.try_element_at("by_kind", F.lit("inline")), F.lit(0)).alias("inline"))


def files_by_language(spark: SparkSession, d: str) -> DataFrame:
    ext = F.concat(F.lit("."), F.substring_index("file", ".", -1))
    rows = table(spark, d, "source_files").withColumn("computed", features.language_of(ext, F.col("content")))
    return rows.groupBy("lang", "computed").agg(F.count("*").alias("n"))


def usable_files(spark: SparkSession, d: str) -> DataFrame:
    return usable(table(spark, d, "source_files"), features.SKIP_PATHS).groupBy("repo").agg(F.count("*").alias("files"))


def newest_extract_counts(spark: SparkSession, d: str) -> DataFrame:
    newest = table(spark, d, "extract_stats").groupBy("source", "repo", "lang").agg(F.max_by(F.struct("files", "comments", "dropped_not_added", "dropped_mixed"), "run_at").alias("x")).select("source", "x.*")
    return newest.groupBy("source").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("files", "comments", "dropped_not_added", "dropped_mixed")))


def stemmed_overlap(spark: SparkSession, d: str) -> DataFrame:
    rows = comparison.full_overlap(table(spark, d, "comments").where("exclude IS NULL"))
    return rows.where("overlap IS NOT NULL").select("comment_id", "n_content", "overlap", "overlap_ext", "jaccard", "matched", "novel")


def chunk_states(spark: SparkSession, d: str) -> DataFrame:
    rows = _pool(spark, d).where("code IS NOT NULL").select("source", F.explode(features.chunks(F.col("text"), F.col("code"))).alias("c"))
    return rows.groupBy("source", F.col("c.state").alias("state")).agg(F.count("*").alias("chunks"))


def overlap_rank_p(spark: SparkSession, d: str) -> DataFrame:
    rows = stats.mann_whitney(_pool(spark, d), "overlap", "source", "ai", "human")
    return rows.withColumns({"p": tails.two_sided_p(F.col("z")), "size": features.delta_word(F.col("delta"))})


def class_contingency_p(spark: SparkSession, d: str) -> DataFrame:
    return stats.chi2(_pool(spark, d), "source", "cls").withColumn("p", tails.chi2_p(F.col("chi2"), F.col("df")))


QUERIES = {
    f.__name__: f for f in (
        marker_comparison, marker_groups, cue_agreement, idiom_rates, style_means, documentation_block, rule_confusion, rule_scores, threshold_scan, rule_kappa, explanatory_interval, density_ratio_interval,
        balanced_languages, blind_sample, pair_examples, eligible_repos, language_quotas, revisions_in_budget, referential_curve, curve_steps, curve_crossings, coarse_histogram, group_sizes, restating_comments,
        comment_blocks, exclusion_reasons, extraction_counts, file_rows, files_by_language, usable_files, newest_extract_counts, stemmed_overlap, chunk_states, overlap_rank_p, class_contingency_p,
    )
}

# SQL. RE2 has no look-around, so boundaries are matched as characters; only whether a phrase occurs is asked.

_P = "WITH p AS (SELECT DISTINCT id, source, lower(trim(lang)) AS lang, kind, repo, overlap, cue, cls, text, code, line FROM pool)\n"
_URL = r"regexp_replace(text, 'https?://\S+|www\.\S+', ' ', 'g')"
_ISSUE = r"regexp_replace({}, '(^|[^\w&])#\d{{1,7}}\b', '\1 ', 'g')"
_REFS = rf"regexp_replace({_ISSUE.format(_ISSUE.format(_URL))}, '\b[A-Z][A-Z0-9]+-\d+\b|\b(?:gh|GH)-\d+\b', ' ', 'g')"
_QUOTES = "'‘’“”', " + "'" * 5 + '""' + "'"
_VIEW = rf"regexp_replace(replace(replace(lower(translate({_REFS}, {_QUOTES})), '&', ' and '), '-', ' '), '\s+', ' ', 'g')"
_TAGS = "regexp_matches(text, '(^|[^A-Za-z])(?:BUG|OPTIMI[SZ]E|REVIEW|HACK)($|[^A-Za-z])')"


def _has(forms: str) -> str:
    body = "|".join(sorted({features.form(f) for f in forms.split("|")}, key=len, reverse=True)).replace(".", r"\.").replace("'", "''")
    return f"regexp_matches(v, '(^|[^a-z0-9''/])(?:{body})($|[^a-z0-9''/])')"


def _marker(category: str) -> str:
    forms = lexicon.MARKERS[category]
    if category == "first_person":
        return f"({_has(forms.removeprefix('i|'))} OR regexp_matches(translate(text, '‘’', ''''''), '(^|[^A-Za-z0-9/])I($|[^A-Za-z0-9/''])'))"
    return f"({_has(forms)} OR {_TAGS})" if category == "tag" else _has(forms)


_CUE = "(" + " OR ".join(_marker(c) for c in lexicon.EXPLANATORY) + ")"
_LABELLED = _P + f", m AS (SELECT *, {_VIEW} AS v FROM p), " + """l AS (SELECT id, source, unnest(list_filter([""" + ", ".join(f"CASE WHEN {_marker(c)} THEN '{c}' END" for c in lexicon.MARKERS) + """], lambda x: x IS NOT NULL)) AS label FROM m WHERE kind IS DISTINCT FROM 'doc')"""
_VERBS = "['" + "', '".join(lexicon.CODE_VERBS) + "']"
_BARE = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
_REFWORDS = rf"regexp_replace(lower(translate({_REFS}, {_QUOTES})), '''s($|[^a-z0-9])', ' \1', 'g')"
_IN = lambda n: f"list_contains({_VERBS}, left(w, length(w) - {n}))"
_VERB = f"""CASE WHEN list_contains({_VERBS}, w) THEN 'imperative'
  WHEN w LIKE '%ies' AND list_contains({_VERBS}, left(w, length(w) - 3) || 'y') OR w LIKE '%es' AND {_IN(2)} OR w LIKE '%s' AND {_IN(1)} THEN 'third_person'
  WHEN w LIKE '%ing' AND ({_IN(3)} OR list_contains({_VERBS}, left(w, length(w) - 3) || 'e') OR length(w) > 5 AND w[-4] = w[-5] AND {_IN(4)}) THEN 'gerund' END"""
_WORD = rf"lower(regexp_extract(translate(text, {_QUOTES}), '^[^A-Za-z0-9_]*([A-Za-z]+)', 1))"
_J = _P + ", j AS (SELECT overlap, cue, cls AS truth, CASE WHEN cue THEN 'explanatory' WHEN round(overlap, 5) >= 0.5 - 1e-12 THEN 'referential' ELSE 'other' END AS rule FROM p), b AS (SELECT * FROM j WHERE truth IS NOT NULL AND rule IS NOT NULL)\n"
_BOOT = """, k AS (SELECT side, num, den, row_number() OVER (PARTITION BY side ORDER BY cluster) - 1 AS place FROM c WHERE side IN ('ai', 'human')), n AS (SELECT side, count(*) AS n FROM k GROUP BY side),
w AS (SELECT t.t AS turn, k.side, ('0x' || substr(md5('7:' || t.t || ':' || k.side || ':' || k.place), 1, 8))::BIGINT % n.n AS place FROM k JOIN n USING (side) CROSS JOIN range(1, 201) t(t)),
s AS (SELECT turn, sum(num) FILTER (side = 'ai') AS na, sum(num) FILTER (side = 'human') AS nb, sum(den) FILTER (side = 'ai') AS da, sum(den) FILTER (side = 'human') AS db FROM w JOIN k USING (side, place) GROUP BY turn),
o AS (SELECT sum(num) FILTER (side = 'ai') AS na, sum(num) FILTER (side = 'human') AS nb, sum(den) FILTER (side = 'ai') AS da, sum(den) FILTER (side = 'human') AS db, count(*) FILTER (side = 'ai') AS ka, count(*) FILTER (side = 'human') AS kb FROM k),
q AS (SELECT quantile_cont(({v})::DOUBLE, 0.025) AS low, quantile_cont(({v})::DOUBLE, 0.975) AS high FROM s)
SELECT round({v}, 6) AS estimate, round(CASE WHEN ka >= 2 AND kb >= 2 THEN low END, 6) AS low, round(CASE WHEN ka >= 2 AND kb >= 2 THEN high END, 6) AS high, ka AS clusters_a, kb AS clusters_b FROM o, q"""
_CURVE = _P + """, h AS (SELECT source, least(floor(overlap * 100 + 1e-9)::INT, 99) AS bin, cue FROM p WHERE overlap IS NOT NULL), c AS (SELECT source, count(*) AS k FROM p WHERE cls IS NOT NULL GROUP BY source),
r AS (SELECT c.source, t.t::INT AS theta, round((SELECT count(*) FROM h WHERE h.source = c.source AND NOT h.cue AND h.bin >= t.t) / c.k, 6) AS share FROM c CROSS JOIN range(20, 91) t(t))
"""
_BANDED = _P + ", f AS (SELECT *, CASE WHEN overlap < 0.25 THEN 'low' WHEN overlap < 0.6 THEN 'mid' ELSE 'high' END AS band FROM p WHERE kind IS DISTINCT FROM 'doc' AND overlap IS NOT NULL AND {})\n"
_BODY = r"regexp_replace(replace(replace(content, E'\r\n', E'\n'), E'\r', E'\n'), '\n\z', '')"
_CODE_LINE = features.CODE_LINE.replace("'", "''")

SQL: dict[str, str] = {
    "marker_comparison": _LABELLED + ", t AS (SELECT count(*) FILTER (source = 'ai') AS na, count(*) FILTER (source = 'human') AS nb FROM p WHERE kind IS DISTINCT FROM 'doc'),\nc AS (SELECT e.label, count(DISTINCT l.id) FILTER (source = 'ai') AS a, count(DISTINCT l.id) FILTER (source = 'human') AS b FROM (SELECT unnest(["
    + ", ".join(f"'{c}'" for c in lexicon.MARKERS) + """]) AS label) e LEFT JOIN l USING (label) GROUP BY e.label),
x AS (SELECT c.*, na, nb, unnest(range(greatest(0, a + b - nb), least(na, a + b) + 1)) AS x FROM c, t),
g AS (SELECT *, lgamma(na + 1) - lgamma(x + 1) - lgamma(na - x + 1) + lgamma(nb + 1) - lgamma(a + b - x + 1) - lgamma(nb - a - b + x + 1) AS lp, lgamma(na + 1) - lgamma(a + 1) - lgamma(na - a + 1) + lgamma(nb + 1) - lgamma(b + 1) - lgamma(nb - b + 1) AS seen,
  lgamma(na + nb + 1) - lgamma(a + b + 1) - lgamma(na + nb - a - b + 1) AS every FROM x),
f AS (SELECT label, any_value(a) AS a, any_value(b) AS b, any_value(na) AS na, any_value(nb) AS nb, least(1.0, coalesce(sum(exp(lp - every)) FILTER (lp <= seen + 1e-7), 1.0)) AS p FROM g GROUP BY label),
r AS (SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM f)
SELECT label, a AS n_a, b AS n_b, round(1000.0::DOUBLE * a / na, 5) AS a_per_1k, round(1000.0::DOUBLE * b / nb, 5) AS b_per_1k, round(((a + 0.5::DOUBLE) * (nb - b + 0.5)) / ((na - a + 0.5::DOUBLE) * (b + 0.5)), 5) AS odds_ratio, round(p, 9) AS p,
  round(least(1.0, min(p * m / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)), 9) AS q FROM r""",
    "marker_groups": _LABELLED + "SELECT source, g AS grp, count(DISTINCT id) AS comments FROM (SELECT *, CASE label " + " ".join(f"WHEN '{c}' THEN '{g}'" for g, cs in lexicon.GROUPS.items() for c in cs.split()) + " ELSE label END AS g FROM l) GROUP BY ALL",
    "cue_agreement": _P + f"SELECT source, cue, coalesce({_CUE}, false) AS computed, count(*) AS n FROM (SELECT *, {_VIEW} AS v FROM p) GROUP BY ALL",
    "idiom_rates": _P + f", m AS (SELECT *, {_VIEW} AS v FROM p WHERE kind IS DISTINCT FROM 'doc'), t AS (SELECT source, count(*) AS n FROM m GROUP BY source), h AS (" + " UNION ALL ".join(
        f"SELECT source, '{c}' AS category, '{k}' AS connotation FROM m WHERE {_has('|'.join(i[3] for i in lexicon.IDIOMS if i[1:3] == (c, k)))}" for c, k in sorted({i[1:3] for i in lexicon.IDIOMS})
    ) + ") SELECT source, category, connotation, count(*) AS comments, round(1000.0::DOUBLE * count(*) / any_value(n), 5) AS per_1k FROM h JOIN t USING (source) GROUP BY ALL",
    "style_means": _P + rf""", m AS (SELECT source, {_BARE} AS t, text, {_WORD} AS w, len(regexp_extract_all({_REFWORDS}, '[a-z][a-z0-9'']+')) AS n FROM p WHERE kind IS DISTINCT FROM 'doc'), v AS (SELECT *, {_VERB} AS verb FROM m)
SELECT source, count(*) AS n, round(avg(n), 6) AS mean_words, round(count(*) FILTER (t LIKE '%?') / count(*), 6) AS is_question, round(count(*) FILTER (t LIKE '%.') / count(*), 6) AS ends_with_period, round(count(*) FILTER (left(t, 1) != lower(left(t, 1))) / count(*), 6) AS starts_upper,
  round(count(*) FILTER (regexp_matches(text, 'https?://\S|www\.\S')) / count(*), 6) AS has_url, round(count(*) FILTER (regexp_matches(text, '(^|[^\w&])#\d{{1,7}}\b|\b[A-Z][A-Z0-9]+-\d+\b|\b(?:gh|GH)-\d+\b')) / count(*), 6) AS has_issue_ref,
  round(count(*) FILTER (verb = 'imperative') / count(*), 6) AS imperative, round(count(*) FILTER (verb = 'third_person') / count(*), 6) AS third_person, round(count(*) FILTER (verb = 'gerund') / count(*), 6) AS gerund FROM v GROUP BY source""",
    "documentation_block": _P + f""", m AS (SELECT *, {_WORD} AS w FROM p WHERE kind = 'doc'), v AS (SELECT *, {_VERB} AS verb FROM m)
SELECT source, count(*) AS n, count(cls) AS classified, round(count(*) FILTER (cls = 'referential') / nullif(count(cls), 0), 6) AS share_referential, round(avg(overlap), 6) AS mean_overlap, round(count(*) FILTER (verb = 'third_person') / count(*), 6) AS third_person FROM v GROUP BY source""",
    "rule_confusion": _J + "SELECT truth, rule, count(*) AS n FROM b GROUP BY ALL",
    "rule_scores": _J + """SELECT c.class, count(*) FILTER (truth = c.class) AS n, round(count(*) FILTER (truth = c.class AND rule = c.class) / nullif(count(*) FILTER (rule = c.class), 0), 6) AS precision,
  round(count(*) FILTER (truth = c.class AND rule = c.class) / nullif(count(*) FILTER (truth = c.class), 0), 6) AS recall, round(2 * count(*) FILTER (truth = c.class AND rule = c.class) / nullif(count(*) FILTER (truth = c.class) + count(*) FILTER (rule = c.class), 0), 6) AS f1,
  round(count(*) FILTER (truth = rule) / count(*), 6) AS accuracy FROM b CROSS JOIN (SELECT truth AS class FROM b UNION SELECT rule FROM b) c GROUP BY c.class""",
    "threshold_scan": _J + """, s AS (SELECT t.t::INT AS theta, round(2 * count(*) FILTER (truth = 'referential' AND NOT cue AND round(overlap, 5) >= t.t / 100 - 1e-12) / nullif(count(*) FILTER (NOT cue AND round(overlap, 5) >= t.t / 100 - 1e-12) + count(*) FILTER (truth = 'referential'), 0), 6) AS f1
  FROM j CROSS JOIN range(20, 91, 2) t(t) WHERE truth IS NOT NULL GROUP BY t.t) SELECT theta, f1, row_number() OVER (ORDER BY f1 DESC NULLS LAST, abs(theta - 50), theta) = 1 AS best FROM s""",
    "rule_kappa": _J + """, n AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (truth = rule) AS same FROM b), e AS (SELECT coalesce(sum(x.k * y.k), 0)::DOUBLE AS c FROM (SELECT truth AS l, count(*) AS k FROM b GROUP BY 1) x JOIN (SELECT rule AS l, count(*) AS k FROM b GROUP BY 1) y USING (l)),
k AS (SELECT n::BIGINT AS n, round(CASE WHEN n > 0 THEN CASE WHEN c / (n * n) = 1 THEN 1.0 ELSE (same / n - c / (n * n)) / (1 - c / (n * n)) END END, 6) AS kappa FROM n, e)
SELECT n, kappa, CASE WHEN kappa < 0 THEN 'poor' WHEN kappa >= 0.8 THEN 'almost perfect' WHEN kappa >= 0.6 THEN 'substantial' WHEN kappa >= 0.4 THEN 'moderate' WHEN kappa >= 0.2 THEN 'fair' ELSE 'slight' END AS word FROM k""",
    "explanatory_interval": _P + ", c AS (SELECT source AS side, repo AS cluster, count(*) FILTER (cls = 'explanatory') AS num, count(*) AS den FROM p WHERE cls IS NOT NULL GROUP BY ALL)" + _BOOT.replace("{v}", "na / nullif(da, 0) - nb / nullif(db, 0)"),
    "density_ratio_interval": "WITH f AS (SELECT DISTINCT source, repo, sha, file, comments, added_lines FROM file_stats), c AS (SELECT source AS side, repo AS cluster, sum(comments) AS num, sum(added_lines) AS den FROM f GROUP BY ALL)" + _BOOT.replace("{v}", "(na / nullif(da, 0)) / nullif(nb / nullif(db, 0), 0)"),
    "balanced_languages": _P + """, q AS (SELECT DISTINCT id, source, lang FROM p WHERE source IN ('ai', 'human')), s AS (SELECT lang, least(count(*) FILTER (source = 'ai'), count(*) FILTER (source = 'human')) AS most FROM q GROUP BY lang)
SELECT id, source, q.lang FROM q JOIN s ON q.lang IS NOT DISTINCT FROM s.lang QUALIFY row_number() OVER (PARTITION BY q.lang, source ORDER BY md5('7:' || id), id) <= most""",
    "blind_sample": _BANDED.format("cls IS NOT NULL AND code IS NOT NULL AND trim(code) != ''") + "SELECT id, source, band, md5('8:' || id) AS place FROM f QUALIFY row_number() OVER (PARTITION BY source, band ORDER BY md5('7:' || id), id) <= 20",
    "pair_examples": _BANDED.format("code IS NOT NULL AND code != ''") + "SELECT source, band, (row_number() OVER (PARTITION BY source, band ORDER BY md5('7:' || id), id))::INT AS rank, id, left(text, 400) AS text FROM f QUALIFY rank <= 6",
    "eligible_repos": "SELECT DISTINCT full_name, language, stars FROM repo_meta WHERE error IS NULL AND NOT coalesce(fork, false) AND NOT coalesce(archived, false) AND left(created_at, 10) < '2024-01-01' AND coalesce(size_kb, 0) <= 200000",
    "language_quotas": "WITH r AS (SELECT DISTINCT full_name, language FROM repo_meta WHERE language IS NOT NULL), c AS (SELECT language, count(*) AS n FROM r GROUP BY 1) SELECT language, n, greatest(1, round_even(100.0::DOUBLE * n / sum(n) OVER (), 0))::INT AS quota FROM c",
    "revisions_in_budget": """WITH m AS (SELECT repo, sha, file, coalesce(max(size), 0) AS size FROM manifest GROUP BY ALL),
w AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY repo ORDER BY md5(concat_ws(':', '7', sha, file)), sha, file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM m) SELECT repo, sha, file FROM w WHERE before < 20000""",
    "referential_curve": _CURVE + "SELECT * FROM r",
    "curve_steps": _CURVE + "SELECT source, theta, fall FROM (SELECT *, round(share - lead(share) OVER (PARTITION BY source ORDER BY theta), 6) AS fall FROM r) WHERE fall >= 0.05",
    "curve_crossings": _CURVE + ", g AS (SELECT theta, round(max(share) FILTER (source = 'ai') - max(share) FILTER (source = 'human'), 6) AS gap FROM r GROUP BY theta) SELECT theta, gap, coalesce(sign(gap) * lag(sign(gap)) OVER (ORDER BY theta) < 0, false) AS crosses FROM g",
    "coarse_histogram": _P + """, h AS (SELECT source, (least(floor(overlap * 100 + 1e-9)::INT, 99) // 5)::INT AS bin, count(*) AS n, count(*) FILTER (NOT cue) AS n_nocue FROM p WHERE overlap IS NOT NULL GROUP BY ALL)
SELECT s.source, b.bin::INT AS bin, coalesce(n, 0) AS n, coalesce(n_nocue, 0) AS n_nocue FROM (SELECT DISTINCT source FROM p) s CROSS JOIN range(20) b(bin) LEFT JOIN h ON h.source = s.source AND h.bin = b.bin""",
    "group_sizes": _P + "SELECT source, count(*) AS n, count(DISTINCT repo) AS repos, count(*) < 300 OR count(DISTINCT repo) < 30 AS few FROM p GROUP BY source",
    "restating_comments": "SELECT DISTINCT id, repo, line, round(overlap, 3) AS overlap FROM pool WHERE kind != 'doc' AND code IS NOT NULL AND overlap IS NOT NULL AND cls = 'referential'",
    "comment_blocks": rf"""WITH s AS (SELECT DISTINCT repo, sha, file, lang, string_split({_BODY}, E'\n') AS l FROM source_files WHERE content != ''), n AS (SELECT repo, sha, file, lang, unnest(l) AS text, unnest(range(1, len(l) + 1))::INT AS line FROM s),
m AS (SELECT *, rtrim(text) AS t FROM n WHERE regexp_matches(text, CASE WHEN lang = 'python' THEN '^\s*#' ELSE '^\s*//' END)), k AS (SELECT *, regexp_matches(t, '^\s*//[/!]') AND NOT regexp_matches(t, '^\s*////') AS is_doc, t LIKE '#!%' AS bang FROM m),
f AS (SELECT *, coalesce(line != lag(line) OVER w + 1 OR is_doc != lag(is_doc) OVER w OR bang OR lag(bang) OVER w, true) AS fresh FROM k WINDOW w AS (PARTITION BY repo, sha, file ORDER BY line)),
i AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY repo, sha, file ORDER BY line) AS island FROM f)
SELECT repo, sha, file, min(line) AS start_line, max(line) AS end_line, bool_or(is_doc) AS is_doc, string_agg(trim(regexp_replace(t, '^\s*(?:#+|//+!?|;+)', '')), E'\n' ORDER BY line) AS text FROM i GROUP BY repo, sha, file, island""",
    "exclusion_reasons": rf"""WITH l AS (SELECT exclude, text, start_line, list_filter(list_transform(string_split(replace(replace(text, E'\r\n', E'\n'), E'\r', E'\n'), E'\n'), lambda x: trim(x, E' \t')), lambda x: x != '') AS lines FROM comments)
SELECT exclude, CASE WHEN text IS NULL OR NOT regexp_matches(text, '[A-Za-z0-9]') THEN 'empty' WHEN regexp_matches(ltrim(text), '{features.DIRECTIVE}') THEN 'directive' WHEN regexp_matches(text, '{features.LICENSE}') OR start_line <= 40 AND regexp_matches(text, '{features.LICENSE_WORDS}') THEN 'license'
  WHEN len(lines) > 0 AND len(list_filter(lines, lambda x: regexp_matches(x, '{_CODE_LINE}'))) >= 0.6 * len(lines) THEN 'code' END AS computed, count(*) AS n FROM l GROUP BY ALL""",
    "extraction_counts": """WITH m AS (SELECT repo, sha, file, arg_max(added_ranges, ingested_at) AS ranges FROM manifest GROUP BY ALL), l AS (SELECT DISTINCT repo, sha, file, unnest(range(r[1], r[2] + 1)) AS line FROM (SELECT repo, sha, file, unnest(ranges) AS r FROM m)),
c AS (SELECT c.comment_id, any_value(c.source) AS source, any_value(c.kind) AS kind, any_value(c.end_line - c.start_line + 1) AS size, count(l.line) AS hit, bool_or(m.file IS NOT NULL AND m.ranges IS NULL) AS whole
  FROM comments c LEFT JOIN m USING (repo, sha, file) LEFT JOIN l ON l.repo = c.repo AND l.sha = c.sha AND l.file = c.file AND l.line BETWEEN c.start_line AND c.end_line GROUP BY c.comment_id)
SELECT source, count(*) FILTER (kind = 'inline') AS raw_inline, count(*) FILTER (kind = 'leading') AS raw_leading, count(*) FILTER (kind = 'block') AS raw_block, count(*) FILTER (kind = 'detached') AS raw_detached, count(*) FILTER (kind = 'doc') AS raw_doc,
  count(*) FILTER (NOT whole AND hit BETWEEN 1 AND size - 1) AS dropped_mixed, count(*) FILTER (NOT whole AND hit = 0) AS dropped_not_added, count(*) FILTER (whole OR hit = size) AS kept FROM c GROUP BY source""",
    "file_rows": rf"""WITH m AS (SELECT repo, sha, file, arg_max(added_ranges, ingested_at) AS ranges, min(source) AS source FROM manifest GROUP BY ALL), s AS (SELECT repo, sha, file, CASE WHEN coalesce(content, '') = '' THEN [] ELSE string_split({_BODY}, E'\n') END AS l FROM source_files),
a AS (SELECT repo, sha, file, m.source, l, CASE WHEN ranges IS NULL THEN range(1, len(l) + 1) ELSE list_distinct(flatten(list_transform(ranges, lambda r: range(greatest(r[1], 1), least(r[2], len(l)) + 1)))) END AS pos FROM s JOIN m USING (repo, sha, file)),
k AS (SELECT repo, sha, file, id, arg_max(kind, (ingested_at, comment_id)) AS kind, arg_max(end_line - start_line + 1, (ingested_at, comment_id)) AS n FROM comments WHERE exclude IS NULL GROUP BY ALL),
t AS (SELECT repo, sha, file, count(*) AS comments, sum(n) AS comment_lines, count(*) FILTER (kind = 'inline') AS inline FROM k GROUP BY ALL)
SELECT repo, sha, file, source, len(pos)::INT AS added_lines, len(list_filter(pos, lambda x: regexp_matches(l[x], '\S')))::INT AS added_nonblank, coalesce(comments, 0) AS comments, coalesce(comment_lines, 0)::BIGINT AS comment_lines, coalesce(inline, 0) AS inline FROM a LEFT JOIN t USING (repo, sha, file)""",
    "files_by_language": r"""SELECT lang, CASE lower('.' || string_split(file, '.')[-1]) WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' WHEN '.jsx' THEN 'javascript' WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'tsx' WHEN '.java' THEN 'java' WHEN '.go' THEN 'go' WHEN '.rs' THEN 'rust' WHEN '.c' THEN 'c' WHEN '.cpp' THEN 'cpp' WHEN '.cc' THEN 'cpp'
  WHEN '.h' THEN CASE WHEN regexp_matches(content, '\b(?:class|namespace|template)\b|std::') THEN 'cpp' ELSE 'c' END END AS computed, count(*) AS n FROM source_files GROUP BY ALL""",
    "usable_files": rf"""SELECT repo, count(*) AS files FROM source_files WHERE regexp_matches(file, '(?i)\.(?:py|js|jsx|ts|tsx|java|go|rs|c|h|cpp|cc)$') AND NOT regexp_matches(replace(file, '\', '/'), '{features.SKIP_PATHS}') AND strlen(content) <= 524288 GROUP BY repo""",
    "newest_extract_counts": """WITH n AS (SELECT * FROM extract_stats QUALIFY row_number() OVER (PARTITION BY source, repo, lang ORDER BY run_at DESC) = 1)
SELECT source, coalesce(sum(files), 0)::BIGINT AS files, coalesce(sum(comments), 0)::BIGINT AS comments, coalesce(sum(dropped_not_added), 0)::BIGINT AS dropped_not_added, coalesce(sum(dropped_mixed), 0)::BIGINT AS dropped_mixed FROM n GROUP BY source""",
}
