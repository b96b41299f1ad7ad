"""Connected components of a link table by local forests and alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize, passing

#: Contraction halves the depth of every tree each time; this many rounds cover any graph that fits a cluster.
MAX_ROUNDS = 60
#: Links that a task unites, and nodes that it remembers; its forest is emitted and begun anew beyond them.
TASK_LINKS, FOREST_NODES = 200_000, 400_000


class Forest(dict):
    """Union-find over ordered labels; the root of a tree is its smallest label."""

    def root(self, x):
        while self.get(x, x) != x:
            self[x] = self.get(self[x], self[x])
            x = self[x]
        return x

    def unite(self, x, y) -> bool:
        """Whether the two were apart."""
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        x, y = min(x, y), max(x, y)
        self[x], self[y] = x, x
        return True


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` has columns a, b; returns stored (node, root), root being the smallest node reachable.

    Nodes without links do not appear.  Each task first unites its own links,
    so that at most one link a node and task is left; the links of a small
    table meet in one task and are settled with that.  Then each round joins
    every edge with the smallest neighbour of one end; neighbours are never
    gathered in lists, and as the smallest neighbours are read from a stored
    table, a hub's edges are a skewed join side that Spark may split.
    """
    spark = links.sparkSession
    with passing(spark):
        tasks = -(-links.count() // TASK_LINKS) or 1
        edges = materialize(_united(links.select("a", "b").where("a <> b").repartition(tasks)), "edges")
        for _ in range(MAX_ROUNDS):
            if _settled(edges):
                break
            edges = materialize(_small_star(materialize(_large_star(edges), "edges")), "edges")
        else:
            raise RuntimeError("components did not settle")
        # settled: every edge runs from a node to its root
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        return materialize(both, "roots", keep=True)


def _united(links: DataFrame) -> DataFrame:
    """Larger node first, no loops; each task's links as stars around the smallest nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = forest = None

        def stars() -> pa.RecordBatch:
            nodes = [x for x in forest if forest.root(x) != x]
            return pa.RecordBatch.from_arrays([pa.array(nodes, kinds), pa.array([forest.root(x) for x in nodes], kinds)], names=["a", "b"])

        for batch in batches:
            if forest is None:
                kinds, forest = batch.schema.field(0).type, Forest()
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                forest.unite(x, y)
            if len(forest) > FOREST_NODES:
                yield stars()
                forest = Forest()
        if forest:
            yield stars()

    return map_batches(links, run, links.schema).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge to its root, and no root an edge of its own."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    per = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return per.where("up > 1 or (up > 0 and down > 0)").isEmpty()


def _tidy(edges: DataFrame) -> DataFrame:
    """Larger node first, no loops, no repeats."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the node's smallest neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    least = materialize(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _tidy(moved.unionByName(least.select("a", F.col("m").alias("b"))))
