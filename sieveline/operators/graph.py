"""Graph operators over edge DataFrames: components, PageRank, degrees, edge pruning, label propagation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.plans.lineage import cut

#: Links that one task may hold at once: 16 MB. More are joined by rounds of Spark's own joins.
TASK_LINKS = 1_000_000


def labelled(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """node, label: the smallest node reachable, of each node of the links; the larger root of each link is hung to the
    smaller one until every link has one root."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y, root = ends[: len(a)], ends[len(a) :], np.arange(len(nodes))
    while len(x):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
        x, y = root[x], root[y]
        apart = x != y
        x, y = x[apart], y[apart]
    return nodes, nodes[root]


def forests(batches: Iterator[pa.RecordBatch], names: tuple[str, str] = ("a", "b")) -> Iterator[pa.RecordBatch]:
    """The links of a task as one link from each node to the smallest that the task knows it to reach."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def joined() -> tuple[np.ndarray, np.ndarray]:
        return labelled(*(np.concatenate(x) for x in zip(*held, strict=True)))

    size = 0
    for batch in batches:
        held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
        size += len(held[-1][0])
        if size > TASK_LINKS:
            held, size = [joined()], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in joined()], names)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", task_links: int = TASK_LINKS, native: bool = False) -> DataFrame:
    """node, component: the smallest node reachable, for every node of the undirected edges.

    Edges between whole numbers are first reduced to a forest by each task. If the forests' links are few, one task joins
    them. Else, and for other ids, each round takes the smallest label among neighbours and then the label of that label,
    so long chains halve. Rounds are checkpointed; nothing but counts reaches the driver. Loops and repeated edges don't
    matter; edges with a null end are left out. If native, there are only these rounds, without Python on the executors.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    if not native and {kind for _, kind in pairs.dtypes} == {"bigint"}:
        pairs = cut(pairs.mapInArrow(forests, "a bigint, b bigint"))
        if pairs.count() <= task_links:
            return cut(pairs.coalesce(1).mapInArrow(lambda batches: forests(batches, ("node", "component")), "node bigint, component bigint"))
    both = cut(pairs.union(pairs.select("b", "a")).distinct())
    labels = cut(both.groupBy("a").agg(F.min(F.least("a", "b")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        lowered = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        roots = labels.select(F.col("node").alias("root"), F.col("label").alias("root_label"))
        jumped = cut(lowered.join(roots, lowered["label"] == roots["root"], "left").select("node", "old", F.least("label", "root_label").alias("label")))
        labels = jumped.select("node", "label")
        if jumped.where("label <> old").isEmpty():
            return labels.withColumnRenamed("label", "component")


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 30) -> DataFrame:
    """nodes: id; edges: src, dst. Returns id, rank after exactly `iterations` steps.

    Repeated edges and loops are collapsed, edges to unknown nodes dropped, the rank of nodes without links is spread
    evenly. Each step is one join and one partial aggregation over links that are made once: beside the edges, each node
    gives 0 to itself, so that all have a row, and a node without edges gives all to the null node, whose row is the
    rank to spread: one number a step comes to the driver. Steps are checkpointed, so plans don't grow.
    """
    ids = cut(nodes.select("id").distinct())
    n = ids.count()
    if not n:
        return ids.withColumn("rank", F.lit(0.0))
    known = cut(edges.where("src <> dst").select("src", "dst").distinct().join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi"))
    degree = known.groupBy("src").agg(F.count("*").alias("out"))
    given = known.join(degree, "src").select("src", "dst", (F.lit(1.0) / F.col("out")).alias("share"))
    own = ids.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("share"))
    loose = ids.join(degree, ids["id"] == degree["src"], "left_anti").select(F.col("id").alias("src"), F.lit(None).cast(ids.schema["id"].dataType).alias("dst"), F.lit(1.0).alias("share"))
    links = cut(given.unionByName(own).unionByName(loose).repartition("src"))
    ranks, spread = ids.select(F.col("id").alias("src"), F.lit(1.0 / n).alias("rank")), 0.0
    for _ in range(iterations):
        sums = cut(links.join(ranks, "src").groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("sum")))
        lost = sums.where("dst IS NULL").first()
        spread = (1 - damping) / n + damping * (float(lost["sum"]) if lost else 0.0) / n
        ranks = sums.where("dst IS NOT NULL").select(F.col("dst").alias("src"), (spread + damping * F.col("sum")).alias("rank"))
    return ranks.select(F.col("src").alias("id"), "rank")


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree, radius of undirected distinct edges; the radius grows with the square root up to degree 8."""
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    counted = ends.groupBy("node").agg(F.count("*").alias("degree"))
    return counted.withColumn("radius", 3.0 + 5.0 * F.least(F.lit(1.0), F.sqrt(F.col("degree") / 8)))
