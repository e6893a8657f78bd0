"""Connected components of an edge table by alternating star operations."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captura.llm.common import materialize


class Forest:
    """Union-find over the nodes of one task."""

    def __init__(self):
        self.parent: dict = {}

    def find(self, x):
        root = x
        while self.parent.get(root, root) != root:
            root = self.parent[root]
        while self.parent.get(x, x) != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        low, high = (a, b) if a < b else (b, a)
        self.parent[high] = low
        self.parent.setdefault(low, low)
        return True


def local_stars(edges: DataFrame, batch_edges: int = 1_000_000) -> DataFrame:
    """The same components from fewer edges: each run of edges in a task becomes stars around its smallest nodes."""

    def stars(batches):
        def flush(forest):
            nodes = list(forest.parent)
            roots = np.array([forest.find(x) for x in nodes], np.int64)
            nodes = np.array(nodes, np.int64)
            keep = nodes != roots
            return pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(roots[keep])], ["u", "v"])

        forest, n = Forest(), 0
        for batch in batches:
            for a, b in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
                forest.join(a, b)
            n += batch.num_rows
            if n >= batch_edges:
                yield flush(forest)
                forest, n = Forest(), 0
        yield flush(forest)

    return edges.select("u", "v").mapInArrow(stars, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node that has an edge (``u, v`` long); the root is the component's smallest node.

    Large-star and small-star steps (Kiveris et al., 2014) alternate until every edge leads to a root. Each
    step groups by node with a minimum, which is combined before the shuffle, and joins it back; edges
    stay in the shared folder between rounds and never reach the driver.
    """
    current = materialize(local_stars(edges.filter("u <> v")).distinct(), "edges")
    while True:
        parents = current.groupBy("u").agg(F.count("v").alias("n"))
        roots = current.select(F.col("v").alias("u")).distinct().join(current, "u", "left_semi")
        if parents.filter("n > 1").isEmpty() and roots.isEmpty():
            break
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = materialize(
            local_stars(small.union(down.select("u", F.col("m").alias("v"))).distinct()).distinct(), "edges"
        )
    nodes = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return materialize(nodes.union(nodes.select("root", "root").distinct()), "components")
