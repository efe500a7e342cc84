"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, written


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node above has one link, and is in no link the node below."""
    one, none = F.lit(1), F.lit(0)
    ends = edges.select(F.inline(F.array(*(F.struct(F.col(c).alias("u"), x.alias("above"), y.alias("below")) for c, x, y in (("hi", one, none), ("lo", none, one))))))
    odd = ends.groupBy("u").agg(F.sum("above").alias("above"), F.max("below").alias("below")).filter("above + below > 1 and above > 0")
    return odd.agg(F.count(F.lit(1))).first()[0] == 0


def components(links: DataFrame) -> DataFrame:
    """(id, component): for every id in the columns ``a`` and ``b`` of ``links``, the least id it is connected with.

    Each round points the neighbours of every node to the least of them (first those above the node, then those
    below), by an aggregation with map-side partial minima and an equi-join whose hot keys can be split. It ends
    when only stars are left, which one aggregation tells: after a number of rounds that grows with the logarithm of
    the largest component. A round's table goes when the next one stands;
    the result is a table that the caller may release.
    """
    up, down = F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")
    edges = written(links.select(up, down).filter("hi <> lo").distinct(), "links")
    while not _is_stars(edges):
        both = edges.select(F.inline(F.array(*(F.struct(F.col(x).alias("u"), F.col(y).alias("v")) for x, y in (("hi", "lo"), ("lo", "hi"))))))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(least, "hi")
        small = joined.filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(least.select("hi", F.col("m").alias("lo"))).distinct()
        before, edges = edges, written(small, "stars")
        released(before)
    out = written(edges.select(F.col("hi").alias("id"), F.col("lo").alias("component")).union(edges.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct()), "components")
    released(edges)
    return out
