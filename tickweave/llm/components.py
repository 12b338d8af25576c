"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.llm.common import discard, materialize


def components(links: DataFrame, least: bool = True) -> DataFrame:
    """(node, comp) for every node of the links (a, b): comp is the least node that it is linked to in any number of steps.

    Each round, a node goes over to that of its neighbours, or itself, which comes first by a hash that changes from round to
    round; links between nodes that went to one place vanish. So the links that are left shrink by a constant factor whatever
    their shape, and the rounds end when none is left. Rounds are written to the shared folder. First neighbours are taken
    before the shuffle, so a node with many neighbours costs its reducer one row a task.

    Without ``least``, comp is some node of the component, the same for all of its nodes; this saves a shuffle. Links of a node
    with itself and repeated links count once; links with a null end are ignored; no links give no rows.
    """
    known = links.select("a", "b").where("a is not null and b is not null")
    edges = materialize(known.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    labels, salt = None, 0
    while labels is None or not edges.isEmpty():
        salt += 1
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("to")), F.struct(F.col("b").alias("node"), F.col("a").alias("to")))).alias("e"))
        order = lambda c: F.struct(F.xxhash64(c, F.lit(salt)).alias("h"), F.col(c).alias("to"))
        up = ends.select("e.node", "e.to").groupBy("node").agg(F.min(order("to")).alias("first"))
        up = materialize(up.select("node", F.least(order("node"), F.col("first"))["to"].alias("up")), "cc-up")
        labels = up.withColumnRenamed("up", "comp") if labels is None else labels.join(up.select(F.col("node").alias("comp"), "up"), "comp", "left").select("node", F.coalesce("up", "comp").alias("comp"))
        ups = [up.select(F.col("node").alias(side), F.col("up").alias(f"up_{side}")) for side in "ab"]
        moved = edges.join(ups[0], "a").join(ups[1], "b").where("up_a <> up_b")
        left = materialize(moved.select(F.least("up_a", "up_b").alias("a"), F.greatest("up_a", "up_b").alias("b")).distinct(), "cc-edges")
        discard(edges)
        edges = left
    if not least:
        return labels
    first = labels.groupBy("comp").agg(F.min("node").alias("least"))
    return labels.join(first, "comp").select("node", F.col("least").alias("comp"))
