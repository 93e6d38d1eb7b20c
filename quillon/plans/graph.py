"""Graphs over the rows of an axis: edges (from, to, ...), nodes numbered from 1."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    """edges: columns from, to and attributes. n_nodes: how many nodes there are, with or without edges."""

    edges: DataFrame
    n_nodes: int

    def __len__(self) -> int:
        return self.n_nodes

    def __getitem__(self, nodes) -> Graph:
        """The subgraph of the chosen nodes, in the order given, numbered anew: edges with both ends chosen."""
        if isinstance(nodes, tuple):
            raise TypeError("a graph has one axis: its nodes")
        if isinstance(nodes, slice):
            nodes = range(1, self.n_nodes + 1)[nodes]
        return self.subset(list(nodes))

    def __setitem__(self, nodes, value) -> None:
        raise TypeError("nodes can't be assigned")

    def __add__(self, other) -> Graph:
        raise TypeError("graphs can't be joined")

    def subset(self, nodes: DataFrame | Sequence[int]) -> Graph:
        """nodes: a list of numbers, or a frame (node, position) for more than a driver should hold."""
        spark = self.edges.sparkSession
        if isinstance(nodes, DataFrame):
            chosen, n = nodes.select("node", "position"), nodes.count()
        else:
            nodes = list(nodes)
            if any(not 1 <= k <= self.n_nodes for k in nodes):
                raise IndexError("no such node")
            if len(set(nodes)) != len(nodes):
                raise IndexError("a node is chosen twice")
            chosen, n = spark.createDataFrame(list(zip(nodes, range(1, len(nodes) + 1), strict=True)), "node long, position long"), len(nodes)
        rest = [c for c in self.edges.columns if c not in ("from", "to")]
        start = chosen.select(F.col("node").alias("from"), F.col("position").alias("__from"))
        end = chosen.select(F.col("node").alias("to"), F.col("position").alias("__to"))
        return Graph(self.edges.join(start, "from").join(end, "to").select(F.col("__from").alias("from"), F.col("__to").alias("to"), *rest), n)

    def induced(self, nodes: DataFrame) -> DataFrame:
        """The edges between the nodes of a frame (node), as they are."""
        keys = nodes.select(nodes[nodes.columns[0]].alias("__node")).distinct()
        return self.edges.join(keys, F.col("from") == F.col("__node"), "left_semi").join(keys, F.col("to") == F.col("__node"), "left_semi")

    def degrees(self) -> DataFrame:
        """(node, degree) of nodes with edges; both ends count."""
        return self.edges.select(F.explode(F.array("from", "to")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
