"""Connected components: stars made in the task until one task holds them, least labels by joins where none can."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineament.plans.storage import dropped, partitions, written

#: Edges that a task holds at a time, and stars that it keeps to meet the next ones.
HELD, KEPT = 1 << 22, 3 << 20


def least_nodes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least): every end of the edges a-b and the least node that it reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        p, q = label[u], label[v]
        apart = p != q
        if not apart.any():
            return nodes, nodes[label]
        u, v, p, q = u[apart], v[apart], p[apart], q[apart]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while not np.array_equal(up := label[label], label):
            label = up


def stars(edges: DataFrame) -> DataFrame:
    """Edges (a, b) as few as nodes, as connected as the given ones: each task's nodes, itself included, with the least they reach there."""

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(tuple(batch.column(k).to_numpy() for k in ("a", "b")))
            n += batch.num_rows
            if n >= HELD:
                node, least = least_nodes(*map(np.concatenate, zip(*held)))
                held, n = [(node, least)], len(node)
                if n > KEPT:
                    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(least)], names=["a", "b"])
                    held, n = [], 0
        if held:
            node, least = least_nodes(*map(np.concatenate, zip(*held)))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(least)], names=["a", "b"])

    return edges.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every end of an edge; component is the least node reachable.

    Edges are undirected; loops make a node of their own, edges with a null end
    are left out, repeated edges count once, and no edges give no rows.

    Tasks make stars of their edges, fewer tasks of those, until one holds all.
    Where that leaves too many nodes for a task, labels go by joins: each
    round takes the least label among neighbours and then follows the label's
    own label, so chains shorten by powers of two.  A node with very many edges
    is met only by a join, which adaptive execution can split, and by a min
    that is combined before the shuffle.
    """
    pairs = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).dropna()
    tasks = partitions(edges.sparkSession)
    found = written(stars(pairs), "stars")
    n = found.count()
    while n > KEPT and tasks > 1:
        tasks = max(1, tasks // 4)
        fewer = written(stars(found.repartition(tasks, "b")), "stars")
        before, n = n, fewer.count()
        dropped(found)
        found = fewer
        if n > 0.9 * before:
            break
    if n <= KEPT:
        out = written(stars(found.repartition(1)).select(F.col("a").alias("node"), F.col("b").alias("component")), "components")
        dropped(found)
        out._lineament_rows = n
        return out
    return labelled(found)


def labelled(pairs: DataFrame) -> DataFrame:
    """components() by joins alone."""
    both = written(pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("n")).agg(F.min("component").alias("least"))
        hop = labels.join(near, labels.node == near.n).select("node", F.least("component", "least").alias("c"), F.col("component").alias("old"))
        hop = written(hop, "hop")
        up = hop.select(F.col("node").alias("m"), F.col("c").alias("top"))
        out = written(hop.join(up, hop.c == up.m).select("node", F.least("c", "top").alias("component"), "old"), "labels")
        changed = out.filter("component <> old").limit(1).count()
        dropped(hop)
        dropped(labels)
        if not changed:
            dropped(both)
            return out.select("node", "component")
        path = out._lineament_path
        labels = out.select("node", "component")
        labels._lineament_path = path
