"""Weakly connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.iterate import cut, fixpoint

#: Ids that are one block, and links that a task collects before it contracts them.
BLOCK, LINKS = 1 << 16, 1 << 21


def smallest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links in order, and the smallest node that each reaches."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = flat[: len(u)], flat[len(u) :]
    low = np.arange(len(nodes))
    while True:
        a, b = low[x], low[y]
        if (a == b).all():
            return nodes, nodes[low]
        np.minimum.at(low, np.maximum(a, b), np.minimum(a, b))
        while (low[low] != low).any():
            low = low[low]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links ``(u, v, across)`` as links of each node to the smallest that it reaches in the task, ``open`` where some node
    of its own has a link across blocks, which another task sees too."""
    u, v, across, held = [], [], [], 0

    def contract() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        nodes, low = smallest(np.concatenate(u), np.concatenate(v))
        return nodes, low, np.unique(np.concatenate(across))

    for batch in batches:
        x, y, c = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        u.append(x), v.append(y), across.append(np.concatenate([x[c], y[c]]))
        held += len(x)
        if held > LINKS:
            nodes, low, crossing = contract()
            u, v, across, held = [nodes], [low], [crossing], 0
    if u:
        nodes, low, crossing = contract()
        open_ = np.isin(low, low[np.searchsorted(nodes, crossing)])
        for at in range(0, len(nodes), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)]) for x in (nodes, low, open_)], ["u", "v", "open"])


def local_labels(edges: DataFrame) -> DataFrame:
    """``component_labels`` of edges between long ids, near ones mostly: each task contracts the links of blocks of
    ids, and only components that cross blocks go on to the rounds."""
    ends = edges.select(F.col("src").cast("long").alias("u"), F.col("dst").cast("long").alias("v")).where("u is not null and v is not null")
    # Where edges lie together that are near, most of them need not travel.
    ends = ends.withColumn("across", F.lit(False)).mapInArrow(_contracted, "u long, v long, open boolean").select("u", "v")
    i, j = (F.floor(F.col(c) / BLOCK) for c in "uv")
    dealt = ends.withColumn("block", F.explode(F.array_distinct(F.array(i, j)))).select("block", "u", "v", (i != j).alias("across"))
    found = cut(dealt.repartition("block").select("u", "v", "across").mapInArrow(_contracted, "u long, v long, open boolean"))
    rest = component_labels(found.where("open"), "u", "v")
    return found.where("not open").select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(rest)


def component_labels(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """``(id, component)`` for each end of an edge; the component is its smallest id.

    Alternates two steps until the links form stars: every node hands its larger neighbours its
    smallest neighbour, then its smaller ones.  Both are a partial aggregate and a join on the node,
    so a hub is split by the skew join, and the number of rounds grows with the logarithm of the size.
    Self loops count as a node; null ends are ignored.
    """
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    links = ends.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def large(links: DataFrame) -> DataFrame:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return both.where("v > u").join(low.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))

    def small(links: DataFrame) -> DataFrame:
        low = links.groupBy("u").agg(F.min("v").alias("m"))
        down = links.join(low.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return down.unionByName(low.select("u", F.col("m").alias("v"))).distinct()

    def round_(links: DataFrame) -> DataFrame:
        # the smallest neighbour itself keeps its link: a node whose neighbours are all larger is a centre
        return small(large(links).unionByName(links.groupBy("u").agg(F.min("v").alias("v"))).distinct())

    stars = fixpoint(links, round_)
    inner = stars.select(F.col("u").alias("id"), F.col("v").alias("component"))
    nodes = ends.select(F.col("u").alias("id")).unionByName(ends.select(F.col("v").alias("id"))).distinct()
    return nodes.join(inner, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
