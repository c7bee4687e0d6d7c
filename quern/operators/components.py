"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources.stage import discard, stage


def components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node on an edge; component is the smallest node reachable.

    ``src`` and ``dst`` share an orderable type; edges with a null end and loops are
    ignored, repeated edges count once, no edges give no rows. Each round hangs every
    node's neighbours on its smallest neighbour (two joins on partially aggregated
    minima, which adaptive execution splits for a hub), so the edge list shrinks to
    stars in a logarithmic number of rounds. Each round is a stage table; nothing but
    two numbers reaches the driver. Fails loudly after ``max_rounds``.
    """
    e = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
    e = stage(e.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).distinct())
    mark = _mark(e)
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = stage(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        discard(e)
        e, was, mark = new, mark, _mark(new)
        if mark == was:
            stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return stars.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
