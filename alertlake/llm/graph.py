"""Connected components by alternating stars; every round is two groupings with map-side minima and two joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertlake.llm.frames import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for the nodes of the edges, except that a component's smallest node is left out.

    Rounds go on until the edges no longer change; then each node points at the smallest node of its component. No list
    of neighbours is built, and what is kept between rounds is written to the shared folder.
    """
    pairs = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo").distinct()
    current, mark = stored(pairs, "edges"), None
    while True:
        found = current.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")), F.sum(F.xxhash64("lo", "hi") % 1_000_003)).first()
        if found == mark or not found[0]:
            return current.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        mark = found
        both = current.select("hi", "lo").union(current.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))).toDF("node", "next")
        least = both.groupBy("node").agg(F.least(F.min("next"), "node").alias("least"))
        large = both.join(least, "node").where("next > node").select(F.col("next").alias("hi"), F.col("least").alias("lo")).distinct()
        floor = large.groupBy("hi").agg(F.min("lo").alias("least"))
        small = large.join(floor, "hi").select(F.col("lo").alias("hi"), F.col("least").alias("lo")).where("hi <> lo")
        current = stored(small.union(floor.select("hi", F.col("least").alias("lo"))).distinct(), "edges")
