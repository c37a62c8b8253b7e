"""Connected components of a large graph, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of all nodes of edges between whole numbers; the component is its smallest node.

    Each round is a few joins and sums of about as many rows as there are edges, written to the
    shared folder. Sums by node are made before the shuffle, so that a node of very many edges
    is no hot key there; joins on such a node can be split. Nulls and edges of a node to itself don't count.
    """
    pair = lambda x, y: F.struct(F.greatest(x, y).alias("u"), F.least(x, y).alias("v"))
    first = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = common.written(first.select(pair(F.col(a), F.col(b)).alias("e")).select("e.u", "e.v").distinct(), "edges")
    seen = _mark(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        now = common.written(small, "edges")
        mark = _mark(now)
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Number and digest of the edges; equal for equal sets."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(h.cast("decimal(20,0)")), F.lit(0)), F.coalesce(F.bit_xor(h), F.lit(0))).first())
