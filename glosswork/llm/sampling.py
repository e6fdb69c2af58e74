"""Stratified sampling to target shares: top-down allocation over a category tree, drawing by permuted dense rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glosswork.plans.common import settle

TREE = ("source", "lang", "band")


def band(overlap: Column) -> Column:
    """`none` for null or NaN, `low` below 0.25, `mid` below 0.5, else `high`."""
    return (
        F.when(overlap.isNull() | F.isnan(overlap), "none")
        .when(overlap < 0.25, "low")
        .when(overlap < 0.5, "mid")
        .otherwise("high")
    )


def cells(pool: DataFrame) -> DataFrame:
    """Distinct (id, source, lang, band) of a pool; `lang` in lower case without outer blanks.

    Rows with a null id have no identity and are left out. A row delivered twice counts once. An id seen in
    several cells counts in each of them.
    """
    return (
        pool.where(F.col("id").isNotNull())
        .select("id", "source", F.lower(F.trim("lang")).alias("lang"), band(F.col("overlap")).alias("band"))
        .distinct()
    )


def needs(targets: DataFrame, n: Column) -> Column:
    """The greater of `min_rows` and target_share x n, rounded half up in decimals."""
    share = F.coalesce(F.col("target_share"), F.lit(0.0)).cast("decimal(20,10)")
    return F.greatest(
        F.coalesce(F.col("min_rows"), F.lit(0)).cast("long"), F.floor(share * n.cast("decimal(20,0)") + F.expr("0.5BD")).cast("long")
    )


def _pass_on(table: DataFrame, group: list[str]) -> DataFrame:
    """One level of the allocation: what the cells of a group lack is taken from the spare rows of its other cells, in order."""
    order = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = order.orderBy(*TREE).rowsBetween(Window.unboundedPreceding, -1)
    upto = order.orderBy(*TREE).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    table = table.withColumns(
        {
            "_lack": F.sum("lack").over(order),
            "_spare": F.sum("spare").over(order),
            "_spare_before": F.coalesce(F.sum("spare").over(before), F.lit(0)),
            "_lack_upto": F.sum("lack").over(upto),
        }
    )
    extra = F.greatest(F.lit(0), F.least(F.col("spare"), F.col("_lack") - F.col("_spare_before")))
    still = F.least(F.col("lack"), F.greatest(F.lit(0), F.col("_lack_upto") - F.col("_spare")))
    return table.withColumns(
        {"allocated": F.col("allocated") + extra, "spare": F.col("spare") - extra, "lack": still}
    ).drop("_lack", "_spare", "_spare_before", "_lack_upto")


def allocate(pool: DataFrame, targets: DataFrame, fraction: int = 5) -> DataFrame:
    """One row for each target cell: need, available, short, allocated, unmet (what no cell of the tree could give).

    N is the number of distinct ids divided by `fraction`, rounded down. A cell first gets the lesser of its need
    and its rows; unmet quota passes to siblings (same source and language), then to cousins (same source), then to
    the rest of the tree. `short` is what the cell itself lacks. Only the counts per cell take part: the pool is
    aggregated before, and the window runs over the target cells (as many as `targets` has rows).
    An empty pool gives need = min_rows and available = 0. Null category values match null targets.
    """
    members = cells(pool)
    total = members.select("id").distinct().agg((F.floor(F.count("*") / F.lit(fraction))).cast("long").alias("n"))
    have = members.groupBy(*TREE).agg(F.count("*").alias("available"))
    goals = targets.select("source", F.lower(F.trim("lang")).alias("lang"), "band", "target_share", "min_rows").distinct()
    h = have.select(*[F.col(c).alias(f"_{c}") for c in TREE], "available")
    joined = goals.join(h, F.expr(" AND ".join(f"{c} <=> _{c}" for c in TREE)), "left").crossJoin(total)
    start = joined.select(
        *TREE, "target_share", "min_rows", needs(joined, F.col("n")).alias("need"), F.coalesce("available", F.lit(0)).alias("available")
    ).withColumns(
        {
            "allocated": F.least("need", "available"),
            "spare": F.greatest(F.lit(0), F.col("available") - F.col("need")),
            "lack": F.greatest(F.lit(0), F.col("need") - F.col("available")),
        }
    )
    start = start.withColumn("short", F.col("lack"))
    for group in (["source", "lang"], ["source"], []):
        start = _pass_on(start, group)
    return start.select(*TREE, "target_share", "min_rows", "need", "available", "short", "allocated", F.col("lack").alias("unmet"))


def draw(pool: DataFrame, targets: DataFrame, fraction: int = 5, seed: int = 7, bins: int = 1024) -> DataFrame:
    """The sample: distinct ids with their cell and rank, `allocated` of each cell.

    Rows are ordered in a cell by a permutation of their ids (a seeded 64-bit hash). So that no task ranks a whole
    cell, the hash is cut into `bins` ranges; a row's dense rank is the number of rows in lower ranges plus its rank
    in its own (cell, range). An id that lies in several cells is drawn for the first of them only.
    """
    goal = allocate(pool, targets, fraction).select(*[F.col(c).alias(f"_{c}") for c in TREE], "allocated")
    one = cells(pool).groupBy("id").agg(F.min(F.struct(*TREE)).alias("c")).select("id", "c.*")
    key = F.xxhash64(F.lit(seed), "id")
    rows = settle(one.withColumn("_key", key).withColumn("_bin", F.floor(F.pmod(F.shiftrightunsigned("_key", 1), F.lit(bins)))))
    counts = rows.groupBy(*TREE, "_bin").agg(F.count("*").alias("k"))
    below = Window.partitionBy(*TREE).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        counts.withColumn("_below", F.coalesce(F.sum("k").over(below), F.lit(0)))
        .select(*[F.col(c).alias(f"_{c}") for c in TREE], F.col("_bin").alias("__bin"), "_below")
        .join(F.broadcast(goal.toDF(*(f"g_{c}" for c in TREE), "allocated")), F.expr(" AND ".join(f"_{c} <=> g_{c}" for c in TREE)))  # as many rows as targets
        .where(F.col("_below") < F.col("allocated"))
    )
    same = F.expr(" AND ".join([*(f"{c} <=> _{c}" for c in TREE), "_bin = __bin"]))
    within = Window.partitionBy(*TREE, "_bin").orderBy("_key", "id")
    ranked = rows.join(offsets, same).withColumn("rank", F.col("_below") + F.dense_rank().over(within))
    return ranked.where(F.col("rank") <= F.col("allocated")).select("id", *TREE, "rank")
