"""Statistics on collapsed tables: rank test, contingency, distinctive words, agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mann_whitney(rows: DataFrame, value: str, group: str, a: str, b: str) -> DataFrame:
    """One row: n1, n2, u, z, delta of group `a` against `b`, with midranks, tie and continuity correction.

    Rows collapse to counts of distinct values before the one ordered window, whose input grows with the distinct
    values only. Nulls do not count; an empty side gives nulls; no variance gives z 0 and delta 0.
    """
    v, g = F.col(value), F.col(group)
    counts = rows.where(v.isNotNull() & g.isin(a, b)).groupBy(v.alias("v")).agg(F.count_if(g == a).alias("x"), F.count_if(g == b).alias("y"))
    below = F.coalesce(F.sum(F.col("x") + F.col("y")).over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = F.col("x") + F.col("y")
    ranks = counts.select("x", "y", (F.col("x") * (below + (t + 1) / 2)).alias("r"), (t.cast("double") * t * t - t).alias("ties"))
    sums = ranks.agg(F.sum("x").alias("n1"), F.sum("y").alias("n2"), F.sum("r").alias("r"), F.sum("ties").alias("ties"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("r") - n1 * (n1 + 1) / 2
    var = n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1)))
    gap = u - n1 * n2 / 2
    z = F.when(var <= 0, 0.0).otherwise(F.try_divide(F.signum(gap) * F.greatest(F.abs(gap) - 0.5, F.lit(0.0)), F.sqrt(var)))
    delta = F.when(var <= 0, 0.0).otherwise(F.try_divide(2 * u, n1 * n2) - 1)
    both = (n1 > 0) & (n2 > 0)
    return sums.select("n1", "n2", F.when(both, u).alias("u"), F.round(F.when(both, z), 6).alias("z"), F.round(F.when(both, delta), 6).alias("delta"))


def chi2(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, chi2, df, cramers_v of the table of `a` by `b`. Rows with a null in either do not count."""
    cells = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("k"))
    ra, rb, total = cells.groupBy("a").agg(F.sum("k").alias("ka")), cells.groupBy("b").agg(F.sum("k").alias("kb")), cells.agg(F.sum("k").alias("n"))
    # sum (o - e)^2 / e = n * (sum o^2 / (row * column) - 1): cells that are empty add nothing, so no grid is built.
    s = cells.join(ra, "a").join(rb, "b").agg(F.sum(F.col("k") * F.col("k") / (F.col("ka") * F.col("kb"))).alias("s"), F.count_distinct("a").alias("na"), F.count_distinct("b").alias("nb"))
    df = (F.col("na") - 1) * (F.col("nb") - 1)
    x = F.when(df > 0, F.col("n") * (F.col("s") - 1)).otherwise(0.0)
    least = F.least("na", "nb") - 1
    return s.join(F.broadcast(total)).select(F.col("n").cast("long").alias("n"), F.round(x, 6).alias("chi2"), df.alias("df"), F.round(F.sqrt(F.try_divide(F.greatest(x, F.lit(0.0)), F.col("n") * least)), 6).alias("cramers_v"))


def log_odds(counts: DataFrame, a: str, b: str, prior: float = 500.0, least: int = 10) -> DataFrame:
    """word, ka, kb, z: log odds of the word counts (source, word, k) of `a` against `b` with an informative prior from both."""
    s = F.col("source")
    words = counts.where(s.isin(a, b)).groupBy("word").agg(F.sum(F.when(s == a, F.col("k")).otherwise(0)).alias("ka"), F.sum(F.when(s == b, F.col("k")).otherwise(0)).alias("kb"))
    totals = words.agg(F.sum("ka").cast("double").alias("na"), F.sum("kb").cast("double").alias("nb"))
    rows = words.where(F.col("ka") + F.col("kb") >= least).join(F.broadcast(totals)).where("na > 0 AND nb > 0")
    p = prior * (F.col("ka") + F.col("kb")) / (F.col("na") + F.col("nb"))
    odds = [F.log((k + p) / (n + prior - k - p)) for k, n in ((F.col("ka"), F.col("na")), (F.col("kb"), F.col("nb")))]
    return rows.select("word", "ka", "kb", F.round((odds[0] - odds[1]) / F.sqrt(1 / (F.col("ka") + p) + 1 / (F.col("kb") + p)), 6).alias("z"))
