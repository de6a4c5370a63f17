"""Connected components by alternating large-star and small-star rounds on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldra.llm.common import checkpoint, drop_unreferenced


def _stars(pairs: DataFrame, large: bool) -> DataFrame:
    """One round. Large: each neighbour above u is linked to u's least neighbour; small: u and its lesser ones are.

    The least neighbour is a grouped minimum (combined before the shuffle), read anew and joined
    back to the pairs, so that Spark can split the partition of a hub's neighbours.
    """
    sides = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs
    least = checkpoint(sides.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
    joined = sides.join(least, "a")
    linked = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return linked.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def connected(pairs: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``a, b`` (long) that isn't a root itself; the root is the least node.

    Each round is checkpointed; rounds end when a whole one changes nothing. Null ends are ignored,
    loops and repeats have no effect, and no pairs give no rows.
    """
    ends = [F.col("a").cast("long"), F.col("b").cast("long")]
    now = pairs.where("a is not null and b is not null and a <> b").select(F.greatest(*ends).alias("a"), F.least(*ends).alias("b")).distinct()
    now = checkpoint(now)
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = seen
        now = checkpoint(_stars(_stars(now, True), False))
        drop_unreferenced(now.sparkSession)
