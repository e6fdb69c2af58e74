"""Selecting comments: accounting of drops, duplicates, caps, balance, and attribution to added lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glosswork.functions import text as T
from glosswork.plans.common import settle

FILE = ("repo", "sha", "file")


def fates(comments: DataFrame, sources: Sequence[str] | None = None) -> DataFrame:
    """Every comment with its `fate`: excluded_<reason>, non_english, duplicate or kept; the first that holds.

    Duplicates have the same source, repo and normal form; the smallest comment_id stays, and rows whose normal form
    is empty are duplicates. Rows of a source outside `sources`, if given, have the fate `unknown_source`. Which row stays is found by a pre-aggregated minimum for each key, so a hot repository
    or a text that a third of the rows share never gathers in one task. Null sources, repos and texts are values.
    """
    key = ["source", "repo", "_key"]
    known = F.lit(True) if sources is None else F.coalesce(F.col("source").isin(*sources), F.lit(False))
    early = F.when(~known, "unknown_source").when(F.col("exclude").isNotNull(), F.concat(F.lit("excluded_"), "exclude")).when(~T.is_english(F.col("text")), "non_english")
    # Written once, with the normal form as a digest: it is read twice, and its features are dear.
    form = T.norm_key(F.col("text"))
    digest = F.when(form != "", F.md5(form))
    rows = settle(comments.select("comment_id", "source", "repo", "lang", "kind", digest.alias("_key"), early.alias("_early")))
    first = rows.where("_early IS NULL AND _key IS NOT NULL").groupBy(*key).agg(F.min("comment_id").alias("comment_id")).select("comment_id", F.lit(True).alias("_first"))
    fate = F.coalesce("_early", F.when(F.col("_first"), "kept").otherwise("duplicate"))
    return rows.join(first, "comment_id", "left").select("comment_id", "source", "repo", "lang", "kind", fate.alias("fate"))


def order_key(seed: int, *columns: str) -> Column:
    """A pseudo-random order that needs no state: the MD5 of the seed and the columns."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns)))


def at_least(rows: DataFrame, group: Sequence[str], least: int) -> DataFrame:
    """Rows of groups that have `least` rows; counted first, then joined, so no group is gathered. Null keys are values."""
    sizes = rows.groupBy(*group).count().where(F.col("count") >= least).drop("count")
    on = None
    sizes = sizes.select(*(F.col(c).alias(f"_g_{c}") for c in group))
    for c in group:
        same = F.col(c).eqNullSafe(F.col(f"_g_{c}"))
        on = same if on is None else on & same
    return rows.join(sizes, on, "left_semi")


def capped(rows: DataFrame, group: Sequence[str], most: int, seed: int = 0, id_col: str = "comment_id") -> DataFrame:
    """`most` rows of each group in pseudo-random order. Spark's group limit cuts every partition to `most` rows before the shuffle."""
    w = Window.partitionBy(*group).orderBy(order_key(seed, id_col), id_col)
    return rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= most).drop("_rank")


def attribution(comments: DataFrame, manifest: DataFrame) -> DataFrame:
    """The comments with `origin`: `all` if one merged added range holds the comment's lines, `mixed` if any meets them, else `none`.

    Files without ranges count as added whole; comments without a file in the manifest have a null origin. The newest
    delivery of a file counts. Null keys are values.
    """
    newest = manifest.groupBy("repo", "sha", "file").agg(F.max_by("added_ranges", "ingested_at").alias("ranges"))
    files = newest.select(*(F.col(k).alias(f"_{k}") for k in FILE), merged(F.col("ranges")).alias("ranges"), F.lit(True).alias("_listed"))
    rows = comments.join(files, F.expr(" AND ".join(f"{k} <=> _{k}" for k in FILE)), "left")
    s, e = F.col("start_line"), F.col("end_line")
    inside = F.exists("ranges", lambda r: (r[0] <= s) & (e <= r[1]))
    meets = F.exists("ranges", lambda r: (r[0] <= e) & (s <= r[1]))
    origin = F.when(F.col("_listed").isNull(), None).when(F.col("ranges").isNull() | inside, "all").when(meets, "mixed").otherwise("none")
    return rows.select(*(F.col(c) for c in comments.columns if c != "origin"), origin.alias("origin"))


def merged(ranges: Column) -> Column:
    """Sorted ranges with those that touch or overlap made one."""
    empty = F.array().cast("array<array<int>>")

    def add(done: Column, r: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.array(last[0], F.greatest(last[1], r[1]))))
        return F.when((F.size(done) > 0) & (r[0] <= F.try_element_at(done, F.lit(-1))[1] + 1), joined).otherwise(F.concat(done, F.array(r)))

    def safe(done: Column, r: Column) -> Column:
        return F.when(F.size(done) == 0, F.array(r)).otherwise(add(done, r))

    return F.aggregate(F.array_sort(ranges), empty, safe)
