"""Graph folders of NumPy arrays, on a file system that driver and executors mount.

A folder has ``edge_index.npy`` (2 x E), ``info.json`` (num_nodes, undir) and, where there are any,
``edge_attr.npy``, ``node_feat.npy`` and ``node_label.npy``.  Arrays are memory-mapped and read in ranges, a task each.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.graph import Graph, numbered
from tessera.plans.iterate import cut

#: Rows of an array that a task reads at a time.
ROWS = 1_000_000


def _ranges(spark: SparkSession, n: int) -> DataFrame:
    count = max(1, -(-n // ROWS))
    return spark.range(0, count, numPartitions=count)


def _edges(spark: SparkSession, folder: str, has_weight: bool) -> DataFrame:
    n = np.load(f"{folder}/edge_index.npy", mmap_mode="r").shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = np.load(f"{folder}/edge_index.npy", mmap_mode="r")
        weight = np.load(f"{folder}/edge_attr.npy", mmap_mode="r").reshape(n) if has_weight else None
        for batch in batches:
            for k in batch.column(0).to_pylist():
                part = slice(k * ROWS, min((k + 1) * ROWS, n))
                columns = [pa.array(np.asarray(index[s, part], np.int64)) for s in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(np.asarray(weight[part], float))] if has_weight else []), ["src", "dst"] + ["weight"] * has_weight)

    return _ranges(spark, n).mapInArrow(run, "src long, dst long" + ", weight double" * has_weight)


def _nodes(spark: SparkSession, folder: str, n: int, has_x: bool, has_y: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = np.load(f"{folder}/node_feat.npy", mmap_mode="r") if has_x else None
        y = np.load(f"{folder}/node_label.npy", mmap_mode="r").reshape(n) if has_y else None
        for batch in batches:
            for k in batch.column(0).to_pylist():
                a, b = k * ROWS, min((k + 1) * ROWS, n)
                columns, names = [pa.array(np.arange(a, b))], ["id"]
                if has_x:
                    rows = np.asarray(x[a:b], float)
                    columns.append(pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1]), pa.int32()), pa.array(rows.ravel())))
                    names.append("x")
                if has_y:
                    part = np.asarray(y[a:b], float)
                    columns.append(pa.array(np.where(np.isnan(part), -1, part).astype(np.int64)))
                    names.append("y")
                yield pa.RecordBatch.from_arrays(columns, names)

    return _ranges(spark, n).mapInArrow(run, "id long" + ", x array<double>" * has_x + ", y long" * has_y)


def read_arrays(spark: SparkSession, folder: str, features: bool = True) -> Graph:
    """The graph in a folder of arrays; labels that are not a number become -1; without ``features`` they are not read."""
    with open(f"{folder}/info.json") as f:
        info = json.load(f)
    there = lambda name: os.path.exists(f"{folder}/{name}.npy")
    return Graph(_edges(spark, folder, there("edge_attr")), _nodes(spark, folder, info["num_nodes"], features and there("node_feat"), there("node_label")))


def write_arrays(graph: Graph, folder: str) -> None:
    """A graph of ids 0 to n-1 as a folder of arrays, its edges sorted; written by the driver, a part at a time."""
    low, high, n = graph.nodes.agg(F.min("id"), F.max("id"), F.count(F.lit(1))).first()
    if n and (low, high) != (0, n - 1):
        raise ValueError("the ids must be 0 to n-1; relabel the graph first")
    os.makedirs(folder, exist_ok=True)
    edges = cut(numbered(graph.weights().withColumn("key", F.struct("src", "dst")), "key"))
    total = edges.count()
    index = np.lib.format.open_memmap(f"{folder}/edge_index.npy", "w+", np.int64, (2, total))
    weight = np.lib.format.open_memmap(f"{folder}/edge_attr.npy", "w+", float, (total,)) if graph.weighted else None
    for r in edges.select("number", "src", "dst", "weight").toLocalIterator():
        index[:, r.number] = r.src, r.dst
        if weight is not None:
            weight[r.number] = r.weight
    for name, column, kind in (("node_feat", "x", float), ("node_label", "y", np.int64)):
        if column in graph.nodes.columns and n:
            width = graph.nodes.agg(F.max(F.size("x"))).first()[0] if column == "x" else 0
            out = np.lib.format.open_memmap(f"{folder}/{name}.npy", "w+", kind, (n, width) if width else (n,))
            for r in graph.nodes.select("id", column).toLocalIterator():
                out[r.id] = r[column] if r[column] is not None else (0 if column == "x" else -1)
    with open(f"{folder}/info.json", "w") as f:
        json.dump({"num_nodes": n, "undir": graph.is_undirected().first()[0]}, f)
