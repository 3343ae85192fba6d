"""The graph: two DataFrames, and the set operators over them."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.components import component_labels, local_labels
from tessera.plans.iterate import cut, kept, sent

#: Nodes, and edges, of a component that one task orders.
IN_TASK = 1_000_000


@dataclass
class Graph:
    """``edges (src, dst[, weight])``, a row for each direction, and ``nodes (id[, label, x, y])``: a node's name, features
    and class, where there are any.  Nodes default to the edges' ends."""

    edges: DataFrame
    nodes: DataFrame = field(default=None)  # type: ignore[assignment]

    def __post_init__(self) -> None:
        self.weighted = "weight" in self.edges.columns
        if self.nodes is None:
            self.nodes = self.edges.select(F.col("src").alias("id")).union(self.edges.select(F.col("dst").alias("id"))).distinct()

    @classmethod
    def from_pairs(cls, pairs: DataFrame, nodes: DataFrame | None = None, weight: str | None = None) -> "Graph":
        """A graph of undirected ``pairs (src, dst, ...)``: both directions, with the column ``weight`` if it is named.  An
        error if some pairs have no weight; if none has one, the graph is unweighted."""
        cols = ["src", "dst"]
        if weight is not None:
            some, all_ = pairs.agg(F.count(weight), F.count(F.lit(1))).first()
            if some not in (0, all_):
                raise ValueError(f"{all_ - some} of {all_} pairs have no {weight!r}")
            cols += [F.col(weight).cast("double").alias("weight")] if some else []
        return Graph(pairs.select(*cols), nodes).symmetrised()

    def metadata(self) -> DataFrame:
        """One row: ``num_nodes``, ``num_edges`` (directed), ``num_features``, ``weighted``, ``has_labels``."""
        features = F.coalesce(F.max(F.size("x")), F.lit(0)) if "x" in self.nodes.columns else F.lit(0)
        nodes = self.nodes.agg(F.count(F.lit(1)).alias("num_nodes"), features.cast("int").alias("num_features"))
        edges = self.edges.agg(F.count(F.lit(1)).alias("num_edges"))
        return nodes.join(F.broadcast(edges)).select("num_nodes", "num_edges", "num_features", F.lit(self.weighted).alias("weighted"), F.lit("label" in self.nodes.columns).alias("has_labels"))

    def to_networkx(self):
        """The graph as a networkx object, for graphs that fit the driver; needs that library."""
        import networkx

        out = networkx.DiGraph()
        for r in self.nodes.toLocalIterator():
            out.add_node(r["id"], **{k: v for k, v in r.asDict().items() if k != "id"})
        for r in self.edges.toLocalIterator():
            out.add_edge(r["src"], r["dst"], **({"weight": r["weight"]} if self.weighted else {}))
        return out

    def adjacent(self, node: int) -> DataFrame:
        """``(id, weight)`` of a node's out-neighbours."""
        return self.weights().where(F.col("src") == node).select(F.col("dst").alias("id"), "weight")

    def weights(self) -> DataFrame:
        """Edges with a weight: 1 where there is none."""
        return self.edges.select("src", "dst", F.coalesce("weight", F.lit(1.0)).alias("weight") if self.weighted else F.lit(1.0).alias("weight"))

    def symmetrised(self) -> "Graph":
        """Both directions of every edge, once each; of weights the largest counts."""
        both = self.weights().unionByName(self.weights().select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
        edges = both.groupBy("src", "dst").agg(F.max("weight").alias("weight"))
        return Graph(edges if self.weighted else edges.drop("weight"), self.nodes)

    def degrees(self) -> DataFrame:
        """``(id, degree, strength)``; isolated nodes have 0."""
        out = self.weights().groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("strength"))
        return self.nodes.select("id").join(out, "id", "left").select("id", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"), F.coalesce("strength", F.lit(0.0)).alias("strength"))

    def is_undirected(self) -> DataFrame:
        """One row: whether each edge's reverse is there with the same weight."""
        w = self.weights()
        missing = w.join(w.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"), ["src", "dst", "weight"], "left_anti")
        return missing.agg((F.count(F.lit(1)) == 0).alias("undirected"))

    def probe(self, pairs: DataFrame) -> DataFrame:
        """``pairs (src, dst)`` with ``is_edge``."""
        known = self.edges.select("src", "dst").distinct().withColumn("is_edge", F.lit(True))
        return pairs.join(known, ["src", "dst"], "left").select("src", "dst", F.coalesce("is_edge", F.lit(False)).alias("is_edge"))

    def neighbours(self, seeds: DataFrame) -> DataFrame:
        """Distinct out-neighbours of ``seeds (id)``."""
        return self.edges.join(seeds.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()

    def levels(self, seeds: DataFrame, hops: int | None = None) -> DataFrame:
        """``(id, hop)`` of the nodes within ``hops`` steps along out-edges (all, if None), the seeds at 0."""
        seen = cut(seeds.select("id").distinct().withColumn("hop", F.lit(0)))
        hop = 0
        while hops is None or hop < hops:
            new = self.neighbours(seen.where(F.col("hop") == hop)).join(seen, "id", "left_anti").withColumn("hop", F.lit(hop + 1))
            seen = cut(seen.unionByName(new))
            hop += 1
            if hops is None and seen.where(F.col("hop") == hop).isEmpty():
                break
        return seen

    def subgraph(self, keep: DataFrame, relabel: bool = False, keep_x: bool = True, keep_y: bool = True) -> "Graph":
        """The edges between nodes of ``keep (id[, order])``, and these nodes with their columns.  With ``relabel`` ids are 0
        to n-1 in order of ``order``, or of the ids, and the old ids are the nodes' ``label``."""
        ids = keep.select("id").distinct()
        edges = self.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*self.edges.columns)
        nodes = self.nodes.drop(*([] if keep_x else ["x"]), *([] if keep_y else ["y"])).join(ids, "id", "left_semi")
        if not relabel:
            return Graph(edges, nodes)
        order = keep.groupBy("id").agg(F.min("order").alias("order")).withColumn("key", F.struct("order", "id")) if "order" in keep.columns else ids.withColumn("key", F.struct("id"))
        numbers = cut(numbered(order.select("id", "key"), "key").select("id", "number"))
        src, dst = numbers.toDF("src", "s"), numbers.toDF("dst", "d")
        edges = edges.join(src, "src").join(dst, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"), *(["weight"] if self.weighted else []))
        nodes = nodes.drop("label").join(numbers, "id").select(F.col("number").alias("id"), F.col("id").alias("label"), *(c for c in ("x", "y") if c in nodes.columns))
        return Graph(edges, nodes)

    def bfs_order(self, start: int | None = None, most: int = IN_TASK) -> DataFrame:
        """``(id, position)``: breadth-first visiting order along out-edges from ``start`` (the smallest id by default),
        neighbours in order of their ids; where nothing is left to reach, it goes on at the smallest id not visited.

        Components of up to ``most`` nodes and edges are ordered in tasks, many in each.  For larger ones levels are found
        by joins, for all at once, from each one's own first node.  In a directed graph, where that may not reach all of
        it, a component starts again until it is done, before the next one comes.
        """
        parts = kept(self.nodes.select("id").join(local_labels(self.edges), "id", "left").select("id", F.coalesce("component", "id").alias("part")))
        first = start if start is not None else parts.agg(F.min("id")).first()[0]
        home = parts.where(F.col("id") == first).select("part").first()
        if home is None:
            raise ValueError(f"no node {start}")
        named = self.edges.select(F.col("src").alias("id"), "dst").join(parts, "id")
        rows = kept(named.select("part", "id", "dst", F.lit(True).alias("edge")).unionByName(parts.select("part", "id", F.col("id").alias("dst"), F.lit(False).alias("edge"))))
        large = kept(rows.groupBy("part").agg(F.count_if("edge").alias("edges"), F.count_if(~F.col("edge")).alias("nodes")).where(f"edges > {most} or nodes > {most}").select("part"))
        some = not large.isEmpty()
        near = rows.join(F.broadcast(large), "part", "left_anti") if some else rows  # fewer than rows / most
        ranked = near.repartition("part").mapInPandas(_visited(first), "part long, id long, head long, step long, at long")
        if some:
            ranked = ranked.unionByName(self._levels(parts.join(F.broadcast(large), "part", "left_semi"), home[0], first))
        turn = F.when(F.col("part") == home[0], F.lit(0)).otherwise(F.lit(1))
        return numbered(ranked.select("id", F.struct(turn.alias("turn"), "head", "step", "at").alias("key")), "key").select("id", F.col("number").alias("position"))

    def _levels(self, parts: DataFrame, home: int, first: int) -> DataFrame:
        """``(part, id, head, step, at)`` of the components ``parts (id, part)``."""
        front = cut(parts.groupBy("part").agg(F.min("id").alias("id")).select(F.when(F.col("part") == home, F.lit(first)).otherwise(F.col("id")).alias("id"), "part").withColumn("at", F.col("id") * 0))
        seen, step = front.withColumn("step", F.lit(0)), 0
        while True:
            step += 1
            reached = front.join(self.edges.select(F.col("src").alias("id"), "dst"), "id").groupBy(F.col("dst").alias("id"), "part").agg(F.min("at").alias("parent"))
            new = cut(reached.join(seen, "id", "left_anti"))
            if new.isEmpty():
                rest = parts.join(seen, "id", "left_anti").groupBy("part").agg(F.min("id").alias("id"))
                new = cut(rest.select("id", "part", F.lit(0).cast("long").alias("parent")))
                if new.isEmpty():
                    break
            front = cut(numbered(new.withColumn("key", F.struct("parent", "id")), "key").select("id", "part", F.col("number").alias("at")))
            seen = cut(seen.unionByName(front.withColumn("step", F.lit(step))))
        heads = seen.where("step = 0").select("part", F.col("id").alias("head"))
        return seen.join(heads, "part").select("part", "id", "head", F.col("step").cast("long").alias("step"), "at")

    def relabelled(self) -> tuple["Graph", DataFrame]:
        """Ids 0 to n-1 in order of the old ones, and ``(id, label)`` with the old id as label.

        Numbers come from counts of id ranges, so no task sees all nodes.
        """
        numbers = cut(numbered(self.nodes.select("id"), "id"))
        src = numbers.select(F.col("id").alias("src"), F.col("number").alias("s"))
        dst = numbers.select(F.col("id").alias("dst"), F.col("number").alias("d"))
        edges = self.edges.join(src, "src").join(dst, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"), *(["weight"] if self.weighted else []))
        return Graph(edges, numbers.select(F.col("number").alias("id"))), numbers.select(F.col("number").alias("id"), F.col("id").alias("label"))

    def components(self) -> DataFrame:
        """``(id, component)`` of weakly connected components, 0 the largest; of equal sizes the one with the
        smallest id comes first."""
        labels = cut(self.nodes.select("id").join(local_labels(self.edges), "id", "left").select("id", F.coalesce("component", "id").alias("root")))
        sizes = labels.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
        order = cut(numbered(sizes.withColumn("key", F.struct(-F.col("size"), "root")), "key"))
        return labels.join(order.select("root", F.col("number").alias("component")), "root").select("id", "component")

    def lcc(self) -> "Graph":
        return self.subgraph(self.components().where("component = 0").select("id"))

    def quotient(self, partition: DataFrame, self_loops: bool = True) -> DataFrame:
        """``(src, dst, weight)`` between clusters of ``partition (id, cluster)``: directed edges counted, weights ignored."""
        a = partition.select(F.col("id").alias("src"), F.col("cluster").alias("c_src"))
        b = partition.select(F.col("id").alias("dst"), F.col("cluster").alias("c_dst"))
        counted = self.edges.join(a, "src").join(b, "dst").groupBy("c_src", "c_dst").agg(F.count(F.lit(1)).alias("weight"))
        return (counted if self_loops else counted.where("c_src <> c_dst")).select(F.col("c_src").alias("src"), F.col("c_dst").alias("dst"), "weight")

    def conductance(self, partition: DataFrame) -> DataFrame:
        """``(cluster, conductance)``: edges that leave a cluster over the smaller of its degree and the rest's."""
        q = self.quotient(partition)
        per = q.groupBy(F.col("src").alias("cluster")).agg(F.sum(F.when(F.col("src") != F.col("dst"), F.col("weight")).otherwise(0)).alias("cut"), F.sum("weight").alias("inside"))
        total = q.agg(F.sum("weight").alias("total"))
        return per.crossJoin(F.broadcast(total)).select("cluster", (F.col("cut") / F.least("inside", F.col("total") - F.col("inside"))).alias("conductance"))

    def conductance_between(self, source: DataFrame, target: DataFrame | None = None) -> DataFrame:
        """One row ``conductance``: edges from ``source (id)`` to ``target (id)``, by default all other nodes, over the smaller
        of both degrees."""
        s = source.select("id").distinct().withColumn("s", F.lit(1))
        t = target.select("id").distinct().withColumn("t", F.lit(1)) if target is not None else self.nodes.select("id").join(s, "id", "left_anti").withColumn("t", F.lit(1))
        named = self.edges.join(s.withColumnRenamed("id", "src"), "src", "left").join(t.toDF("src", "ts"), "src", "left").join(t.toDF("dst", "td"), "dst", "left")
        cut_, low = F.count(F.when((F.col("s") == 1) & (F.col("td") == 1), 1)), F.least(F.count("s"), F.count("ts"))
        return named.agg((cut_ / low).alias("conductance"))

    def conductance_weights(self) -> "Graph":
        """Weights over the smaller strength of an edge's ends."""
        s = self.degrees().select("id", "strength")
        w = self.weights().join(s.toDF("src", "s"), "src").join(s.toDF("dst", "t"), "dst")
        return Graph(w.select("src", "dst", (F.col("weight") / F.least("s", "t")).alias("weight")), self.nodes)

    def mutual_nearest(self, k: int) -> "Graph":
        """Edges that are among the ``k`` heaviest of both their ends; ties go to the smaller id."""
        w = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
        top = self.weights().withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= int(k)).drop("rank")
        back = top.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        return Graph(top.join(back, ["src", "dst"], "left_semi"), self.nodes)

    def heaviest_forest(self, maximise: bool = True, most: int = 2_000_000) -> DataFrame:
        """Canonical edges ``(src < dst, weight)`` of a spanning forest.

        Edges come by weight, ties by the smaller ends, which is one total order and so one forest.  Beyond ``most``
        edges tasks first drop those that are in no forest of their own edges.  What is left one task takes in turn; where
        it is still more than ``most``, in Boruvka rounds, every component takes its best edge out.
        """
        sign = F.lit(-1.0 if maximise else 1.0)
        edges = cut(self.weights().where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight").groupBy("src", "dst").agg(F.max("weight").alias("weight") if maximise else F.min("weight").alias("weight")))
        count = edges.count()
        while count > most:  # an edge that is in no forest of some edges is in none of all
            n = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count // most))
            fewer = kept(edges.repartitionByRange(n, "src").mapInPandas(_forests(maximise), "src long, dst long, weight double"))
            edges, before, count = fewer, count, fewer.count()
            if count > 0.7 * before:
                break
        if count <= most:
            return cut(edges.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_in_turn(maximise), "src long, dst long, weight double"))
        labels = self.nodes.select("id", F.col("id").alias("root"))
        tree: DataFrame | None = None
        while True:
            a, b = labels.toDF("src", "ra"), labels.toDF("dst", "rb")
            out = edges.join(a, "src").join(b, "dst").where("ra <> rb")
            ends = out.select(F.explode(F.array("ra", "rb")).alias("root"), F.struct((sign * F.col("weight")).alias("w"), "src", "dst").alias("e"))
            picked = cut(ends.groupBy("root").agg(F.min("e").alias("e")).select("e.src", "e.dst", (sign * F.col("e.w")).alias("weight")).distinct())
            if picked.isEmpty():
                return tree if tree is not None else picked
            tree = cut(picked if tree is None else tree.unionByName(picked).distinct())
            # What was joined before is one node now: only the round's own edges join roots.
            joined = picked.join(a, "src").join(b, "dst").select(F.col("ra").alias("src"), F.col("rb").alias("dst"))
            roots = component_labels(joined).select(F.col("id").alias("root"), F.col("component").alias("above"))
            labels = cut(labels.join(roots, "root", "left").select("id", F.coalesce("above", "root").alias("root")))

    def sample_negative(self, n: int, seed: int = 0) -> DataFrame:
        """``n`` pairs of different nodes that are no edge, drawn with replacement; needs a sparse graph."""
        labels, have = cut(numbered(self.nodes.select("id"), "id")), None
        size = labels.count()
        s, d = (sent(labels, size).select(F.col("number").alias(x), F.col("id").alias(y)) for x, y in (("s", "src"), ("d", "dst")))
        spark = self.edges.sparkSession
        for k in range(20):
            drawn = cut(spark.range(2 * n).select(F.floor(F.rand(seed + 2 * k) * size).cast("long").alias("s"), F.floor(F.rand(seed + 2 * k + 1) * size).cast("long").alias("d")).where("s <> d"))
            more = drawn.join(s, "s").join(d, "d").select("src", "dst")
            have = more if have is None else have.unionByName(more)
            found = cut(have.join(self.edges.select("src", "dst"), ["src", "dst"], "left_anti").limit(n))
            if found.count() >= n:
                return found
        raise ValueError("the graph has too few pairs that are no edge")

    def sample_positive(self, n: int, seed: int = 0) -> DataFrame:
        """``n`` edges drawn with replacement: numbers are drawn and looked up."""
        edges = numbered(self.edges.select(F.struct("src", "dst").alias("key")), "key").select("key.src", "key.dst", "number")
        total = edges.count()
        if not total:
            raise ValueError("the graph has no edge to draw")
        drawn = cut(self.edges.sparkSession.range(n).select(F.floor(F.rand(seed) * total).cast("long").alias("number")))
        return edges.join(sent(drawn, n), "number").select("src", "dst")


def _visited(first: int):
    """Breadth-first order of whole components, given as rows ``(part, id, dst, edge)``, those of nodes no edge."""

    def run(batches):
        batches = list(batches)
        if not batches:
            return
        rows = pd.concat(batches)
        edge = rows.edge.to_numpy(bool)
        nodes, place = np.unique(rows.id.to_numpy()[~edge], return_index=True)
        part = rows.part.to_numpy()[~edge][place]
        src, dst = (np.searchsorted(nodes, rows[c].to_numpy()[edge]) for c in ("id", "dst"))
        order = np.lexsort((dst, src))
        ends, to = np.concatenate([[0], np.cumsum(np.bincount(src, minlength=len(nodes)))]), dst[order]
        free, step, at = np.ones(len(nodes), bool), np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
        head, level, front = {}, 0, np.empty(0, np.int64)
        while free.any():
            count = ends[front + 1] - ends[front]
            found = to[np.repeat(ends[front] - np.cumsum(count) + count, count) + np.arange(count.sum())]  # of each of the front in turn
            found = found[free[found]]
            front = found[np.sort(np.unique(found, return_index=True)[1])]
            if not len(front):  # each component starts at its smallest node that is left
                left = np.flatnonzero(free)
                front = left[np.unique(part[left], return_index=True)[1]]
                if not level:
                    k = np.flatnonzero(nodes == first)
                    front = np.where(part[front] == part[k[0]], k[0], front) if len(k) else front
                    head = pd.Series(nodes[front], index=part[front])
            free[front], step[front], at[front] = False, level, np.arange(len(front))
            level += 1
        if len(nodes):
            yield pd.DataFrame({"part": part, "id": nodes, "head": head.loc[part].to_numpy(), "step": step, "at": at})

    return run


def _in_turn(maximise: bool):
    """Takes a graph's edges by weight, those that join two trees."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["weight", "src", "dst"], ascending=[not maximise, True, True], ignore_index=True)
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        keep, left = np.zeros(len(rows), bool), len(pd.unique(rows[["src", "dst"]].to_numpy().ravel())) - 1
        for k, (a, b) in enumerate(zip(rows.src.tolist(), rows.dst.tolist(), strict=True)):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)], keep[k], left = min(a, b), True, left - 1
                if not left:
                    break
        return rows.loc[keep, ["src", "dst", "weight"]]

    return run


def _forests(maximise: bool):
    def run(batches):
        batches = list(batches)
        if batches:
            yield _in_turn(maximise)(pd.concat(batches))

    return run


def numbered(rows: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """``rows`` with ``number``: 0 to n-1 in order of ``key`` (unique), by range counts and row numbers within."""
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = kept(rows.repartitionByRange(n, key).sortWithinPartitions(key).withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return ranged.join(F.broadcast(before), "_part").withColumn("number", F.col("_before") + F.col("_place")).drop("_part", "_place", "_before")


def rolling_window_graph(n_patches: DataFrame, offsets: list[int]) -> DataFrame:
    """``(src, dst)`` between patches of ``n_patches (patch)`` whose numbers differ by an offset, both directions."""
    step = n_patches.select(F.col("patch").alias("src"), F.explode(F.array(*(F.lit(o) for o in offsets))).alias("o"))
    one = step.select("src", (F.col("src") + F.col("o")).alias("dst")).join(n_patches.select(F.col("patch").alias("dst")), "dst", "left_semi")
    return one.select("src", "dst").unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
