"""Aggregates over classified comments: mixes, histograms, quartiles, threshold curves, densities, word counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glosswork.functions import text as T

CLASSES = ("explanatory", "referential", "other")


def share(part, whole):
    return F.round(F.try_divide(part, whole), 6)


def function_mix(pool: DataFrame, *by: str) -> DataFrame:
    """Counts of each class, undecided rows and shares of the classified rows by the columns `by`. Null shares where nothing is classified."""
    known = F.count_if(F.col("cls").isNotNull())
    counts = [F.count_if(F.col("cls") == c).alias(c) for c in CLASSES]
    shares = [share(F.count_if(F.col("cls") == c), known).alias(f"share_{c}") for c in CLASSES]
    return pool.groupBy(*by).agg(F.count("*").alias("n"), known.alias("classified"), F.count_if(F.col("cls").isNull()).alias("undecided"), *counts, *shares)


def histogram(pool: DataFrame) -> DataFrame:
    """source, bin 0..99, n and n_nocue of the rows with an overlap; all bins of every source that occurs."""
    rows = pool.where("overlap IS NOT NULL").groupBy("source", T.bin100(F.col("overlap")).alias("bin")).agg(F.count("*").alias("n"), F.count_if(~F.col("cue")).alias("n_nocue"))
    grid = pool.select("source").distinct().select("source", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("bin"))
    return grid.join(rows, ["source", "bin"], "left").na.fill(0, ["n", "n_nocue"])


def sensitivity(pool: DataFrame, low: int = 20, high: int = 80, step: int = 5) -> DataFrame:
    """source, theta in hundredths, share of classified rows without a cue whose overlap reaches theta.

    Rows collapse to their distinct overlaps first; only those few values meet the thresholds.
    """
    values = pool.where("cls IS NOT NULL").groupBy("source", "overlap", "cue").agg(F.count("*").alias("k"))
    steps = values.withColumn("theta", F.explode(F.sequence(F.lit(low), F.lit(high), F.lit(step))))
    hit = (~F.col("cue")) & (F.col("overlap") >= F.col("theta") / 100 - 1e-12)
    return steps.groupBy("source", "theta").agg(share(F.sum(F.when(hit, F.col("k")).otherwise(0)), F.sum("k")).alias("share"))


def describe(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """n, mean, and exact quartiles with linear interpolation. Nulls do not count."""
    v = F.col(value)
    return rows.where(v.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(v), 6).alias("mean"), *(F.round(F.percentile(v, q), 6).alias(a) for a, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))))


def mass_points(pool: DataFrame, top: int = 4) -> DataFrame:
    """The `top` most frequent overlaps of each source, to four places, with their shares; ties go to the smaller value."""
    counts = pool.where("overlap IS NOT NULL").groupBy("source", F.round("overlap", 4).alias("value")).agg(F.count("*").alias("k"))
    w = Window.partitionBy("source")
    ranked = counts.select("*", F.row_number().over(w.orderBy(F.desc("k"), "value")).alias("rank"), share(F.col("k"), F.sum("k").over(w)).alias("share"))
    return ranked.where(F.col("rank") <= top)


def density(stats: DataFrame, *by: str) -> DataFrame:
    """Comments for 100 added lines and for 100 lines that are not blank, share of comment lines, and the median over repositories.

    Ratios of sums; repeated rows of a file revision count once; null where nothing was added.
    """
    columns = ["source", "lang", "repo", "sha", "file", "added_lines", "added_nonblank", "comments", "comment_lines"]
    sums = [F.sum(c).alias(c) for c in columns[5:]]
    repos = stats.select(*columns).distinct().groupBy(*by, "repo").agg(*sums)
    per = F.try_divide(F.col("comments") * 100.0, F.col("added_lines"))
    return repos.withColumn("_per", per).groupBy(*by).agg(
        F.count("*").alias("repos"), share(F.sum("comments") * 100.0, F.sum("added_lines")).alias("per100"), share(F.sum("comments") * 100.0, F.sum("added_nonblank")).alias("per100_nonblank"),
        share(F.sum("comment_lines") * 1.0, F.sum("added_lines")).alias("line_share"), F.round(F.percentile("_per", 0.5), 6).alias("median_per100"),
    )


def word_counts(rows: DataFrame, least: int = 3) -> DataFrame:
    """source, word, k over all texts: words of `least` letters or more that are no stop words."""
    words = rows.select("source", F.explode(T.comment_words(F.col("text"))).alias("word"))
    return words.where((F.length("word") >= least) & ~F.col("word").isin(T.STOPWORDS)).groupBy("source", "word").agg(F.count("*").alias("k"))


def bigrams(rows: DataFrame, top: int = 25, least: int = 3) -> DataFrame:
    """The `top` pairs of neighbouring words of each source; both of `least` letters and no stop words. Ties by the pair."""
    words = T.comment_words(F.col("text"))
    pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    each = rows.select("source", F.explode(pairs).alias("p")).select("source", "p.a", "p.b")
    ok = [(F.length(c) >= least) & ~F.col(c).isin(T.STOPWORDS) for c in ("a", "b")]
    counts = each.where(ok[0] & ok[1]).groupBy("source", F.concat_ws(" ", "a", "b").alias("pair")).agg(F.count("*").alias("k"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("k"), "pair"))).where(F.col("rank") <= top)
