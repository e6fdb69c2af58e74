"""Choosing rows and repositories: balance, blind samples, examples, budgets, quotas, commits by phrase, time windows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glosswork.operators.pool import order_key


def balanced(rows: DataFrame, by: str, side: str, a: str, b: str, seed: int = 0, id_col: str = "id") -> DataFrame:
    """For each value of `by` as many rows of side `a` as of `b`: the lesser of both counts, drawn in pseudo-random order. A value that one side lacks vanishes; null is a value."""
    sizes = rows.where(F.col(side).isin(a, b)).groupBy(F.col(by).alias("_by")).agg(F.least(F.count_if(F.col(side) == a), F.count_if(F.col(side) == b)).alias("_most")).where("_most > 0")
    w = Window.partitionBy(by, side).orderBy(order_key(seed, id_col), id_col)
    joined = rows.where(F.col(side).isin(a, b)).join(sizes, F.col(by).eqNullSafe(F.col("_by")))
    return joined.withColumn("_rank", F.row_number().over(w)).where("_rank <= _most").select(*rows.columns)


def without_docs(rows: DataFrame, docs: bool = False) -> DataFrame:
    """The rows whose kind is not `doc`, or only those."""
    return rows.where(F.col("kind") == "doc" if docs else ~F.col("kind").eqNullSafe("doc"))


def bands(overlap: Column, low: float = 0.25, high: float = 0.6) -> Column:
    return F.when(overlap < low, "low").when(overlap < high, "mid").when(overlap.isNotNull(), "high")


def blind_sample(pool: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """id, source, band and an order that tells neither: max(1, n // 6) rows of each source and band of overlap.

    Eligible are comments with code, an overlap and a class that are no documentation. Each group is cut to its size in
    every partition before the shuffle.
    """
    fit = without_docs(pool).where("overlap IS NOT NULL AND cls IS NOT NULL AND code IS NOT NULL AND trim(code) != ''").withColumn("band", bands(F.col("overlap")))
    w = Window.partitionBy("source", "band").orderBy(order_key(seed, "id"), "id")
    return fit.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= max(1, n // 6)).select("id", "source", "band", order_key(seed + 1, "id").alias("place"))


def examples(pool: DataFrame, each: int = 6, theta: float = 0.5, seed: int = 0) -> DataFrame:
    """source, band, rank, id, text (400 characters), code (six lines, 500 characters): `each` pairs of a source and band; high from max(theta, 0.6) on."""
    fit = without_docs(pool).where("overlap IS NOT NULL AND code IS NOT NULL AND code != ''").withColumn("band", bands(F.col("overlap"), high=max(theta, 0.6)))
    w = Window.partitionBy("source", "band").orderBy(order_key(seed, "id"), "id")
    cut = F.substring(F.substring_index("code", "\n", 6), 1, 500)
    return fit.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= each).select("source", "band", "rank", "id", F.substring("text", 1, 400).alias("text"), cut.alias("code"))


def eligible_repos(meta: DataFrame, before: str, most_kb: int) -> DataFrame:
    """Repositories without an error that are no forks, not archived, created before a day and not above a size, each once. Null flags and sizes do not exclude."""
    ok = F.col("error").isNull() & ~F.coalesce("fork", F.lit(False)) & ~F.coalesce("archived", F.lit(False)) & (F.substring("created_at", 1, 10) < before) & (F.coalesce("size_kb", F.lit(0)) <= most_kb)
    return meta.where(ok).select("full_name", "language", "stars").distinct()


def quotas(rows: DataFrame, by: str, total: int) -> DataFrame:
    """by, n, quota: `total` split like the rows, rounded half to even, one at least. Nulls do not count; the quotas may sum to another total."""
    counts = rows.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("whole"))
    return counts.join(F.broadcast(whole)).select(by, "n", F.greatest(F.lit(1), F.bround(F.lit(total) * F.col("n") / F.col("whole")).cast("int")).alias("quota"))  # one row


def within_budget(rows: DataFrame, group: str, order: Sequence[str], size: str, budget: int, seed: int = 0) -> DataFrame:
    """In each group the rows in pseudo-random order up to and with the one that passes the budget. The running sum holds one group's rows, sorted on disk if need be; null sizes are 0."""
    w = Window.partitionBy(group).orderBy(order_key(seed, *order), *order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_before", F.coalesce(F.sum(F.coalesce(F.col(size), F.lit(0))).over(w), F.lit(0))).where(F.col("_before") < budget).drop("_before")


def commits_with(commits: DataFrame, tools: Mapping[str, str]) -> DataFrame:
    """The commits whose message has the phrase of a tool in any case, with `tools` (all that match, in the order given) and `tool` (the first)."""
    hits = F.filter(F.array(*(F.when(F.contains(F.lower("message"), F.lit(p.lower())), t) for t, p in tools.items())), lambda x: x.isNotNull())
    return commits.withColumn("tools", hits).where(F.size("tools") > 0).withColumn("tool", F.col("tools")[0])


def commits_without(commits: DataFrame, tools: Mapping[str, str], before: str) -> DataFrame:
    """The commits before a day whose message has no phrase of a tool. A null message has none."""
    any_ = F.greatest(*(F.coalesce(F.contains(F.lower("message"), F.lit(p.lower())), F.lit(False)) for p in (*tools.values(), *list(tools.values())[:1])))
    return commits.where((F.substring("date", 1, 10) < before) & ~any_)


def suspects(commits: DataFrame, phrases: Sequence[str], sure: DataFrame) -> DataFrame:
    """The commits with one of the phrases that are not among the sure ones, by sha."""
    return commits.where(F.lower("message").rlike("|".join(r"\Q" + p.lower() + r"\E" for p in phrases))).join(sure.select("sha").distinct(), "sha", "left_anti")


def time_windows(spans: DataFrame, hours: int) -> DataFrame:
    """start, end: closed windows of so many hours over each span (columns start, end), the last second of one before the first of the next."""
    steps = F.sequence(F.col("start"), F.col("end") - F.expr("INTERVAL 1 SECOND"), F.expr(f"INTERVAL {int(hours)} HOURS"))
    rows = spans.where(F.col("start") < F.col("end")).select(F.col("end").alias("_end"), F.explode(steps).alias("start"))
    return rows.select("start", F.least(F.col("start") + F.expr(f"INTERVAL {int(hours)} HOURS"), F.col("_end")).alias("end")).withColumn("end", F.col("end") - F.expr("INTERVAL 1 SECOND"))
