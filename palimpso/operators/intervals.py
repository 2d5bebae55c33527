"""Overlap joins of intervals with intervals by bins that the data size.

Days are cut into ``LEAVES`` bins that hold about as many ends of intervals each (equi-depth, from both sides).  The bins are the leaves of a binary tree.
An interval is copied to the few nodes that make it up (two a level at most), a day to the nodes above its bin (one a level), and the two meet
in exactly one node if the day's bin is among the interval's.  So an interval that is open at one end costs as few copies as a short one.

Two intervals overlap if the first begins within the second, or the second begins after the first has begun and before it has ended; these are two
such joins of days with intervals, and no pair is in both.  Whole bins need no further test; at the edges the days themselves are compared.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAVES = 256


def edges(days: DataFrame, leaves: int = LEAVES) -> list[int]:
    """At most ``leaves - 1`` days between which about as many of the column ``day`` lie."""
    share = F.array(*[F.lit(k / leaves) for k in range(1, leaves)]) if leaves > 1 else F.array().cast("array<double>")
    found = days.agg(F.percentile_approx("day", share, F.lit(10_000)).alias("edges")).first()["edges"] if leaves > 1 else None
    return sorted(set(found or ()))


def with_bins(rows: DataFrame, bounds: list[int], columns: dict[str, str]) -> DataFrame:
    """For each column of days (key) the number of its bin (value)."""
    from pyspark.ml.feature import Bucketizer

    doubles = {f"{c}_": F.col(c).cast("double") for c in columns}
    # a bin begins with its edge
    cut = Bucketizer(splitsArray=[[-math.inf, *map(float, bounds), math.inf]] * len(columns), inputCols=list(doubles), outputCols=[f"{o}_" for o in columns.values()])
    out = cut.transform(rows.withColumns(doubles)) if bounds else rows.withColumns(doubles | {f"{o}_": F.lit(0) for o in columns.values()})
    return out.withColumns({o: F.col(f"{o}_").cast("int") for o in columns.values()}).drop(*doubles, *[f"{o}_" for o in columns.values()])


def above(bin_: Column, levels: int) -> Column:
    """The nodes above a bin, as (level, number)."""
    return F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(bin_, k).alias("node")) for k in range(levels + 1)])


def making_up(first: Column, last: Column, levels: int) -> Column:
    """The nodes that make up the bins from ``first`` to ``last``."""
    out = []
    for k in range(levels + 1):
        lo, hi = F.shiftright(first + F.lit((1 << k) - 1), k), F.shiftright(last + 1, k)  # whole nodes of the level, the second is the first beyond
        node = lambda n, k=k: F.struct(F.lit(k).alias("level"), n.alias("node"))
        top = k == levels
        out.append(F.when((lo < hi) & ((lo % 2 == 1) | F.lit(top)), node(lo)))
        if not top:
            # an odd end leaves the last node to this level, unless it is the one just taken
            out.append(F.when((lo < hi) & (hi % 2 == 1) & ~((hi - 1 == lo) & (lo % 2 == 1)), node(hi - 1)))
    return F.array_compact(F.array(*out))


def overlap_join(left: DataFrame, right: DataFrame, leaves: int = LEAVES, report: bool = False) -> DataFrame:
    """All pairs that overlap; ``left`` has days (numbers) ``_from`` to ``_last``, ``right`` ``_low`` to ``_high``, both included.

    Rows with a null end, and empty intervals, overlap nothing.  With ``report``: ``side``, ``rows`` and ``copies`` instead.
    """
    left, right = left.filter("_from <= _last"), right.filter("_low <= _high")
    days = left.select(F.explode(F.array("_from", "_last")).alias("day")).unionByName(right.select(F.explode(F.array("_low", "_high")).alias("day")))
    bounds = edges(days, leaves)
    levels = max(0, math.ceil(math.log2(len(bounds) + 1)))
    left, right = with_bins(left, bounds, {"_from": "_a", "_last": "_b"}), with_bins(right, bounds, {"_low": "_c", "_high": "_d"})
    met = lambda rows, nodes: rows.withColumn("_at", F.explode(nodes)).select("*", F.col("_at.level").alias("_level"), F.col("_at.node").alias("_node")).drop("_at", "_a", "_b", "_c", "_d")
    if report:
        # each side goes to both joins, once as days and once as intervals
        copies = lambda rows, name, a, b: rows.agg(F.lit(name).alias("side"), F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.size(making_up(F.col(a), F.col(b), levels)) + levels + 1), F.lit(0)).cast("long").alias("copies"))
        return copies(left, "left", "_a", "_b").unionByName(copies(right, "right", "_c", "_d"))
    begins = met(left, above(F.col("_a"), levels)).join(met(right, making_up(F.col("_c"), F.col("_d"), levels)), ["_level", "_node"]).filter("_from >= _low and _from <= _high")
    later = met(left, making_up(F.col("_a"), F.col("_b"), levels)).join(met(right, above(F.col("_c"), levels)), ["_level", "_node"]).filter("_low > _from and _low <= _last")
    return begins.unionByName(later).drop("_level", "_node")
