"""Connected components by alternating large-star and small-star steps on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every id that is not the smallest of its component.

    A step moves each node's larger neighbours, then its smaller ones, to the smallest neighbour, so
    long chains shorten by halves and a hot node's edges never meet in one task: minima are summed on
    the map side and joined back.  Nulls and loops are no edges.
    """
    ends = (F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = written(edges.where(F.col(a) != F.col(b)).select(*ends).distinct(), "edges")
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(moved.union(low.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))


def roots(links: DataFrame) -> DataFrame:
    """(id, component) of every `b` of links (a, b) that name one smaller `a` for each b, so they are trees.

    A step hangs each node under its parent's parent, so paths shorten by halves.
    """
    found = written(links.select(F.col("b").alias("id"), F.col("a").alias("component")), "parents")
    while True:
        above = found.select(F.col("id").alias("component"), F.col("component").alias("above"))
        up = found.join(above, "component", "left")
        up = written(up.select("id", F.coalesce("above", "component").alias("component"), F.isnotnull("above").alias("moved")), "parents")
        found = up.drop("moved")
        if not up.where("moved").take(1):
            return found
