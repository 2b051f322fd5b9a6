"""Connected components over an edge table, by repeated contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.runtime import materialize, ship


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, up) of a bounded graph: every node with the smallest node it reaches."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            p, q = top(a), top(b)
            if p != q:
                parent[max(p, q)] = min(p, q)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], names=["node", "up"])


def components(edges: DataFrame, a: str = "a", b: str = "b", finish: int = 250_000) -> DataFrame:
    """(node, root) for every node that has an edge to another; root is the component's
    smallest node.

    In each round every node joins the neighbour, or itself, whose salted hash is least;
    the graph of the nodes chosen goes to the next round. Hashes are salted anew each
    round, which shrinks any graph, a long path too, by a constant share. Rounds end when
    no edge is left. Nodes' choices are minima, so they are combined before the shuffle
    and a node with very many neighbours costs no more than its partial minima. Each
    round's tables are written to the shared folder. As soon as a counted ``finish`` edges
    or fewer are left, a few megabytes, one task ends the work.
    """
    spark = edges.sparkSession
    left = materialize(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "edges")
    maps: list[DataFrame] = []
    while (n := left.count()) > 0:
        if n <= finish:
            ship(spark)
            maps.append(materialize(left.coalesce(1).mapInArrow(_finish, "node long, up long"), "choice"))
            break
        salt = F.lit(len(maps) + 1)
        both = left.select("a", "b").union(left.select(F.col("b"), F.col("a")))
        # the hash decides, the node itself breaks ties; both fit one mutable aggregate buffer
        best = both.groupBy(F.col("a").alias("node")).agg(F.min(F.xxhash64("b", salt)).alias("h"), F.min_by("b", F.xxhash64("b", salt)).alias("n"))
        own = F.xxhash64("node", salt)
        chosen = materialize(best.select("node", F.when(own <= F.col("h"), F.col("node")).otherwise(F.col("n")).alias("up")), "choice")
        maps.append(chosen)
        x = chosen.select(F.col("node").alias("a"), F.col("up").alias("x"))
        y = chosen.select(F.col("node").alias("b"), F.col("up").alias("y"))
        smaller = left.join(x, "a").join(y, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        left = materialize(smaller.distinct(), "edges")
    if not maps:
        return spark.createDataFrame([], "node long, root long")
    up = maps[-1]
    for lower in reversed(maps[:-1]):
        above = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
        up = lower.join(above, "up", "left").select("node", F.coalesce("top", "up").alias("up"))
    roots = up.groupBy("up").agg(F.min("node").alias("root"))
    return materialize(up.join(roots, "up").select("node", "root"), "components")
