"""Connected components of a table of links, by alternating large and small stars.

Every round is two aggregations with partial sums and two joins whose one side has a row for each
node, so a hub with a third of all links can be split over tasks.  Each round's links are written to
the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _pairs(u, v):
    return F.greatest(u, v).alias("u"), F.least(u, v).alias("v")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    joined = links.join(least, "u")
    return joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame, u: str = "a", v: str = "b", at_most: int | None = None) -> DataFrame:
    """``node`` and ``root``, the least node it is linked with; nodes that are their own root are left out.

    ``at_most`` bounds the links, if that is known.
    """
    now = materialize(links.filter(F.col(u) != F.col(v)).select(*_pairs(F.col(u), F.col(v))).distinct(), "links", at_most)
    mark = None
    while True:
        before = now
        now = materialize(_small_star(_large_star(before).distinct()).distinct(), "links", at_most)
        discard(before)
        new = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if new == mark:
            out = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            out._written_to, out._owned_by = now._written_to, now._owned_by
            return out
        mark = new
