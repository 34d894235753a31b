"""Connected components of a link table by repeated contraction, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

MAX_ROUNDS = 60
#: Rounds that rank nodes by themselves.
PLAIN_ROUNDS = 2


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for each node of ``links``; a component is named by its smallest node.

    In each round every node moves to the lowest-ranked of itself and its neighbours, and links
    between nodes that moved together vanish. The first rounds rank by the node itself, which settles
    stars and cliques at once; later ones by a hash, which shortens chains by a constant factor. A
    node with very many links is no hot spot: minima are taken before the shuffle, and the joins have
    one row a node on one side.
    """
    edges = links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()
    steps: list[DataFrame] = []
    for step in range(MAX_ROUNDS):
        edges = written(edges)
        if edges.isEmpty():
            break
        rank = lambda c: F.struct((F.lit(0) if step < PLAIN_ROUNDS else F.xxhash64(F.lit(step), c)).cast("long").alias("h"), F.col(c).alias("n"))  # noqa: E731, B023
        both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
        moves = written(both.groupBy(F.col("a").alias("node")).agg(F.min(rank("b")).alias("m")).select("node", F.least("m", rank("node"))["n"].alias("to")))
        steps.append(moves)
        left, right = moves.select(F.col("node").alias("a"), F.col("to").alias("ta")), moves.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        moved = edges.join(left, "a").join(right, "b").where("ta <> tb")
        edges = moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct()
    else:
        raise RuntimeError("components did not settle")
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("component"))
    at = steps[0].withColumnRenamed("to", "root")
    for moves in steps[1:]:
        at = at.join(moves.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    at = written(at)
    names = at.groupBy("root").agg(F.min("node").alias("component"))
    return at.join(names, "root").select("node", "component")
