"""Classes of linked ids."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswork.plans.common import settle

FLUSH = 200_000
# Stars of so many ids are brought together in one task, which holds them all.
WHOLE = 1_000_000


def _stars(batches: Iterator[pa.RecordBatch], most: float | None = None) -> Iterator[pa.RecordBatch]:
    """The links of a partition as stars around the smallest id of each local class; given out whenever `most` (FLUSH) ids are held."""
    most = most or FLUSH
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := above.get(x, x)) != x:
            above[x] = x = above.get(y, y)
        return x

    def stars() -> pa.RecordBatch:
        pairs = [(x, top(x)) for x in above]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["u", "v"])

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x, y = top(x), top(y)
            if x != y:
                above[max(x, y)] = min(x, y)
        if len(above) > most:
            yield stars()
            above.clear()
    yield stars()


def components(edges: DataFrame, a: str, b: str, label: str, ids: int | None = None) -> DataFrame:
    """(a, label): for each id that has a link, the smallest id that it reaches over links.

    Links of one partition are made stars where they are. Up to WHOLE stars, or the stars of up to WHOLE ids (`ids`: so many there are at the most), meet in one task. Beyond that each round makes stars over all: the larger neighbours of an id are hung on the smallest id around it, then its smaller
    neighbours and itself. Rounds grow with the logarithm of the longest path, the edges never become more, and an id
    that all others link to is met by pre-aggregation and a join that can be split. Only whether a round has changed
    anything is known to the driver. Links of an id with itself and null ids do not count.
    """
    links = edges.where(F.col(a) != F.col(b)).select(F.col(a).cast("long"), F.col(b).cast("long"))
    stars = settle(links.mapInArrow(_stars, "u long, v long"))
    if (ids is not None and ids <= WHOLE) or stars.limit(WHOLE + 1).count() <= WHOLE:
        stars = settle(stars.coalesce(1).mapInArrow(lambda batches: _stars(batches, math.inf), "u long, v long"))
        return stars.select(F.col("u").alias(a), F.col("v").alias(label)).union(stars.select("v", "v").distinct())
    stars = settle(stars.distinct())
    seen = None
    while True:
        both = stars.union(stars.select(F.col("v"), F.col("u"))).toDF("u", "v")
        near = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(near.hint("merge"), "u").where("v > u AND v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("p")).select("p.u", "p.v")
        stars = settle(small.where("u != v").distinct())
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if now == seen:
            return stars.select(F.col("u").alias(a), F.col("v").alias(label)).union(stars.select("v", "v").distinct())
        seen = now
