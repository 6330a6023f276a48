"""Connected components of an edge table by alternating large and small stars.

Every round is two aggregations and two joins over the edges, so no task holds a component and
nothing goes to the driver but two sums. The rounds end when the edges no longer change: each
vertex then has one edge, to its component's smallest vertex.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _sums(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """(vertex, component) of every vertex of ``edges`` (u, v long); component is its smallest vertex.

    Loops and repeated edges don't matter, rows with a null are left out, no edges give no rows.
    """
    now = materialize(edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _sums(now)
    while seen[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        now = materialize(small, "edges")
        last, seen = seen, _sums(now)
        if seen == last:
            break
    return now.select(F.col("u").alias("vertex"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v")).distinct())
