"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.llm.common import write_and_read


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node in ``links(a, b)``; component is its smallest node.

    In each round every node goes over to the neighbour that comes first in a hashed order
    (or stays), then to where that one went; links between the nodes left are gathered
    anew. A hashed order keeps rounds logarithmic whatever the shape, hubs included. All
    steps are joins and minima; each round is written to the shared folder, which keeps
    plans short and survives lost executors. Self-links and repeated links do no harm.
    """

    def gathered(df: DataFrame) -> DataFrame:
        pair = df.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        return write_and_read(pair.distinct(), "links")

    def order(c: str) -> F.Column:
        return F.struct(F.xxhash64(c).alias("h"), F.col(c).cast("long").alias("v"))

    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    moves, left = [], gathered(links)
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        move = (
            both.groupBy("a")
            .agg(F.min(order("b")).alias("best"))
            .select("a", F.least(order("a"), F.col("best"))["v"].alias("to"))
        )
        move = write_and_read(move, "moves")
        onward = move.select(F.col("a").alias("to"), F.col("to").alias("on"))
        move = move.join(onward, "to").select("a", F.col("on").alias("to"))
        move = write_and_read(move, "moves")
        moves.append(move)
        first = move.select("a", F.col("to").alias("a2"))
        second = move.select(F.col("a").alias("b"), F.col("to").alias("b2"))
        left = gathered(
            left.join(first, "a").join(second, "b").select(F.col("a2").alias("a"), F.col("b2").alias("b"))
        )
    at = nodes.withColumn("at", F.col("node"))
    for move in moves:
        step = move.select(F.col("a").alias("at"), "to")
        at = at.join(step, "at", "left").select("node", F.coalesce("to", "at").alias("at"))
    at = write_and_read(at, "places")
    smallest = write_and_read(at.groupBy("at").agg(F.min("node").alias("component")), "smallest")
    return at.join(smallest, "at").select("node", "component")
