"""Connected components of an edge table by alternating star contractions.

Each round is two groupings (with partial aggregation) and two equi-joins over
the current edges, written to shared storage, so the lineage stays short.  The
smallest neighbours are stored before they are joined back, so both sides of a
join are plain exchanges and adaptive execution can split the edges of a hub.
Edges never come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import drop_path, save


def _star(pairs: DataFrame, large: bool, path: str) -> DataFrame:
    """One contraction of (a > b) edges: neighbours of a node move to its smallest."""
    if large:
        near = pairs.union(pairs.select(F.col("b"), F.col("a"))).toDF("u", "v")
    else:
        near = pairs.toDF("u", "v")
    least = save(near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), path)
    joined = near.join(least.withColumnRenamed("u", "of"), F.col("u") == F.col("of"))
    if large:
        return joined.where("v > u and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
    return out.where("a <> b").distinct()


def _settled(pairs: DataFrame) -> bool:
    """Whether each node is either a leaf with one edge or a head."""
    ends = pairs.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(pairs.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, component) for each node of the two-column edge table; component is the smallest node.

    Null ends and loops are left out.
    """
    a, b = edges.columns
    pairs = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(f"`{a}` is not null and `{b}` is not null and `{a}` <> `{b}`").distinct()
    pairs, k = save(pairs, f"{folder}/pairs-0"), 0
    while not _settled(pairs):
        k += 1
        wide = save(_star(pairs, True, f"{folder}/large-{k}"), f"{folder}/wide-{k}")
        pairs = save(_star(wide, False, f"{folder}/small-{k}"), f"{folder}/pairs-{k}")
        for old in (f"pairs-{k - 1}", f"large-{k}", f"wide-{k}", f"small-{k}"):
            drop_path(edges.sparkSession, f"{folder}/{old}")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(pairs.select("b", "b").distinct())
