"""Connected components by alternating star contractions, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrweave.plans.shared import drop, materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame, src: str = "u", dst: str = "v", max_rounds: int = 60) -> DataFrame:
    """``node``, ``component`` (the smallest node that it reaches) for every node of an undirected edge list.

    Nodes without an edge are not listed. Self-loops, repeated and null ends are ignored. A round moves edges to
    smaller neighbours; rounds grow with the logarithm of a component's diameter. A node with very many edges is joined
    with one row, so that a skewed side can be split by adaptive execution. The result is written to the shared folder.
    """
    ends = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where(F.col("u") != F.col("v"))
    now = materialize(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components")
    state = _state(now)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(moved.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "components")
        before, state, old = state, _state(after), now
        now = after
        drop(old.sparkSession, old)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    found = materialize(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), "found")
    drop(now.sparkSession, now)
    return found
