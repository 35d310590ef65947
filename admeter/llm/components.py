"""Connected components of an undirected graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Rows of one key that go to one task, about; parts that keys with more rows are cut into at first.
HOT, PARTS = 10_000, 16


def part_of(node: Column, parts: Column | int) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(parts) if isinstance(parts, int) else parts).cast("int")


def in_parts(df: DataFrame, parts: Column | int) -> DataFrame:
    """``df`` once for each part, numbered by ``part``: the small side of a join whose other side is cut by ``part_of``."""
    last = F.lit(parts - 1) if isinstance(parts, int) else parts - 1
    return df.withColumn("part", F.explode(F.sequence(F.lit(0), last.cast("int"))))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of ``edges`` (a, b): the component is its smallest node.

    Labels spread to neighbours, then each node takes the label of its label, which halves the way; each round is
    written to the shared folder.  Ends when no label changes.  The centre of a large star is a key that many rows share, as
    neighbour and as label; such keys are joined in parts.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).union(edges.select("b", "a")).distinct()
    degrees = both.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    hubs = in_parts(degrees.where(F.col("degree") > HOT).select(F.col("node").alias("near"), F.ceil(F.col("degree") / HOT).cast("int").alias("parts")), PARTS)
    cut = both.withColumn("part", part_of(F.col("node"), PARTS)).join(hubs, ["near", "part"], "left")
    parts = F.coalesce("parts", F.lit(1))
    both = saved(cut.select("node", "near", part_of(F.col("node"), parts).alias("part")), "edges")
    labels = saved(both.groupBy("node").agg(F.least("node", F.min("near")).alias("label"), F.ceil(F.count(F.lit(1)) / HOT).cast("int").alias("parts")), "labels")
    while True:
        told = in_parts(labels.select(F.col("node").alias("near"), F.col("label").alias("other"), "parts"), F.col("parts")).drop("parts")
        sent = both.join(told, ["near", "part"]).groupBy("node").agg(F.min("other").alias("other"))
        spread = labels.join(sent, "node").select("node", F.least("label", "other").alias("label"), F.col("label").alias("old"), "parts")
        # only labels that have a smaller one themselves
        further = spread.where("label < node").select(F.col("node").alias("label"), F.col("label").alias("further"))
        further = in_parts(further.join(spread.select("label").distinct(), "label", "left_semi"), PARTS)
        jumped = spread.withColumn("part", part_of(F.col("node"), PARTS)).join(further, ["label", "part"], "left")
        jumped = saved(jumped.select("node", F.coalesce("further", "label").alias("label"), "old", "parts"), "labels")
        if jumped.where("label <> old").isEmpty():
            return jumped.select("node", F.col("label").alias("component"))
        labels = jumped.select("node", "label", "parts")
