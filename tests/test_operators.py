"""Kernels and randomised operators by brute force and invariants."""

import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import align, embed, partition, thin
from tessera.operators.components import component_labels
from tessera.operators.graph import Graph
from tessera.sources import tables


def both(pairs):
    return [(a, b, w) for a, b, w in pairs] + [(b, a, w) for a, b, w in pairs]


def graph(spark, pairs):
    return Graph(spark.createDataFrame(both(pairs), "src long, dst long, weight double"))


TRIANGLES = [(0, 1, 1.0), (1, 2, 2.0), (0, 2, 3.0), (3, 4, 4.0), (4, 5, 5.0), (3, 5, 6.0), (2, 3, 7.0)]


def find_all(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(150), r.randrange(150)) for _ in range(110)] + [(200 + i, 201 + i) for i in range(60)] + [(500, 500)]
    assert dict(map(tuple, component_labels(spark.createDataFrame(edges, "src long, dst long")).collect())) == find_all(edges)
    assert component_labels(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_relabel_and_save(spark, tmp_path):
    g = graph(spark, [(10, 30, 1.0), (30, 70, 2.0)])
    new, labels = g.relabelled()
    assert {(r.id, r.label) for r in labels.collect()} == {(0, 10), (1, 30), (2, 70)}
    assert {(r.src, r.dst, r.weight) for r in new.edges.collect()} == set(both([(0, 1, 1.0), (1, 2, 2.0)]))
    tables.save(g, str(tmp_path / "g"))
    assert tables.open_folder(spark, str(tmp_path / "g")).edges.count() == 4
    with pytest.raises(ValueError):
        tables.load("nothing", spark, "")


def test_flow_files(spark, tmp_path):
    for day, n in (("day-02", 3), ("day-03", 5)):
        (tmp_path / f"netflow_{day}_aggregate_tcp.csv").write_text(f"1,2,{n}.0,1,1,10,20\n1,2,1.0,1,1,10,20\n")
    flows = tables.read_flows(spark, str(tmp_path), days=["day-03"])
    assert [tuple(r) for r in tables.adjacency(flows).collect()] == [("day-03", 1, 2, 2.0)]
    assert tables.adjacency(tables.read_flows(spark, str(tmp_path)), "total_time").agg(F.sum("weight")).first()[0] == 10.0


@pytest.mark.parametrize("most", [100, 3])
def test_spanning_forest(spark, most):
    """In one task, and in rounds."""
    tree = {(r.src, r.dst) for r in graph(spark, TRIANGLES + [(8, 9, 1.0)]).heaviest_forest(most=most).collect()}
    assert tree == {(1, 2), (0, 2), (2, 3), (4, 5), (3, 5), (8, 9)}
    low = {(r.src, r.dst) for r in graph(spark, TRIANGLES).heaviest_forest(False, most=most).collect()}
    assert low == {(0, 1), (1, 2), (2, 3), (3, 4), (4, 5)}


def test_resistance_sums_to_nodes_less_components(spark):
    rows = thin.resistances(graph(spark, TRIANGLES)).collect()
    assert abs(sum(r.weight * r.resistance for r in rows) - 5) < 1e-9
    assert abs(next(r.weight * r.resistance for r in rows if (r.src, r.dst) == (2, 3)) - 1) < 1e-9


def test_sparsified_graphs_stay_connected(spark):
    rng = random.Random(2)
    g = graph(spark, [(a, b, rng.random() + 0.1) for a in range(20) for b in range(a)])
    for f in (thin.resistance_sparsify, thin.sample_sparsify, thin.neighbour_sparsify):
        out = f(g, 4).edges.collect()
        assert len(set(find_all([(r.src, r.dst) for r in out]).values())) == 1 and len(out) < 380
    assert thin.relaxed_tree(g, gamma=0.0).edges.count() >= 38


def test_negative_samples_are_no_edges(spark):
    g = graph(spark, TRIANGLES)
    got = [(r.src, r.dst) for r in g.sample_negative(20).collect()]
    assert len(got) == 20 and not {(a, b) for a, b, _ in both(TRIANGLES)} & set(got) and all(a != b for a, b in got)
    assert g.sample_positive(50).count() == 50


def test_partitions(spark):
    g = graph(spark, TRIANGLES)
    part = spark.createDataFrame([(i, i) for i in range(6)], "id long, cluster long")
    merged = partition.merge_small(g, part, 3).collect()
    sizes = pd.Series([r.cluster for r in merged]).value_counts()
    assert len(merged) == 6 and sizes.min() >= 3
    assert {r.cluster for r in partition.fennel(g, 2).collect()} == {0, 1}
    assert partition.label_propagation(g).count() == 6
    two = spark.createDataFrame([(i, i // 3) for i in range(6)], "id long, cluster long")
    pairs = spark.createDataFrame([(0, 1), (1, 0)], "i long, j long")
    patches = {(r.patch, r.node) for r in partition.overlapping_patches(g, two, pairs, 2, 4).collect()}
    assert {(i // 3, i) for i in range(6)} <= patches and {(1, 2), (0, 3)} <= patches and len(patches) == 10
    with pytest.raises(ValueError):
        partition.overlapping_patches(g, two, pairs, 20, 40)


def walked(nodes, edges, seeds, rounds):
    """Clusters by dense products of the lazy walk."""
    at = {v: i for i, v in enumerate(nodes)}
    w = np.zeros((len(nodes), len(nodes)))
    for a, b, c in edges:
        w[at[b], at[a]] += c
    s = w.sum(axis=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        w = np.where(w > 0, w / np.sqrt(np.outer(s, s)), 0)
    x = np.zeros((len(nodes), len(seeds)))
    for k, v in enumerate(seeds):
        x[at[v], k] = 1 / np.sqrt(s[at[v]])
    for _ in range(rounds):
        x = x / 2 + w @ x / 2
    return {v: seeds[int(np.round(x[i], 12).argmax())] if x[i].any() else None for i, v in enumerate(nodes)}


@pytest.mark.parametrize("most", [10**6, 30])
def test_diffusion_by_components(spark, monkeypatch, most):
    """Components in tasks, their seeds in several deals, and a larger one by joins; nothing reaches the last nodes."""
    rng = np.random.default_rng(2)
    pairs = {(a, b): float(rng.integers(1, 9)) for k, n in ((0, 30), (100, 12), (200, 5)) for a in range(k, k + n) for b in range(a + 1, k + n) if b == a + 1 or rng.random() < 0.2}
    edges = [(a, b, w) for (x, y), w in pairs.items() for a, b in ((x, y), (y, x))]
    nodes, seeds = sorted({a for a, _, _ in edges} | {300}), [0, 3, 7, 11, 20, 29, 101, 104]
    monkeypatch.setattr(partition, "SEEDS", 4)
    monkeypatch.setattr(partition, "_by_joins", partition._by_joins if most == 30 else None)
    g = Graph(spark.createDataFrame(edges, "src long, dst long, weight double"), spark.createDataFrame([(v,) for v in nodes], "id long"))
    got = partition.diffusion(g, spark.createDataFrame([(v,) for v in seeds], "id long"), 4, most=most)
    assert dict(map(tuple, got.collect())) == walked(nodes, edges, seeds, 4)


def test_diffusion_keeps_no_edges(spark, monkeypatch):
    """Edges are not written again, and a batch's neighbours of a node travel as one row."""
    wrote = []
    monkeypatch.setattr(partition, "kept", lambda df, kept=partition.kept: wrote.extend(df.columns) or kept(df))
    edges = [(0, 1, 1.0), (1, 0, 1.0), (1, 2, 3.0), (2, 1, 3.0)]
    g = Graph(spark.createDataFrame(edges, "src long, dst long, weight double").coalesce(1))
    got = partition.diffusion(g, spark.createDataFrame([(0,), (2,)], "id long"), 3)
    assert dict(map(tuple, got.collect())) == walked([0, 1, 2], edges, [0, 2], 3)
    assert wrote and "dst" not in wrote
    batch = pa.RecordBatch.from_pydict({"part": [0, 0, 0], "last": [0, 0, 0], "id": [5, 4, 5], "dst": [4, 5, 6], "weight": [1.0, 2.0, 3.0]})
    out = [r for b in partition._packed([batch.slice(0, 0), batch]) for r in b.to_pylist()]
    assert [(r["id"], sorted(zip(r["dst"], r["weight"], strict=True))) for r in out] == [(4, [(5, 2.0)]), (5, [(4, 1.0), (6, 3.0)])]


def greedy(nodes, edges, k, load, gamma):
    n, cluster, size = len(nodes), {}, [0] * k
    alpha = len(edges) * k ** (gamma - 1) / n**gamma
    for v in sorted(nodes):
        gain = [sum(a == v and cluster.get(b) == c for a, b in edges) - alpha * gamma * size[c] ** (gamma - 1) if size[c] + 1 <= load * n / k else -np.inf for c in range(k)]
        cluster[v] = int(np.argmax(gain))
        size[cluster[v]] += 1
    return cluster


def test_fennel_assigns_isolated_nodes(spark):
    edges = [(a, b) for a, b, _ in both(TRIANGLES)]
    nodes = [-4, *range(6), 2**60, 2**60 + 1, 50, 51, 52]
    g = Graph(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(i,) for i in nodes], "id long"))
    assert dict(map(tuple, partition.fennel(g, 3).collect())) == greedy(nodes, edges, 3, 1.1, 1.5)
    alone = Graph(spark.createDataFrame([], "src long, dst long"), g.nodes)
    assert {r.id for r in partition.fennel(alone, 3).collect()} == set(nodes)


@pytest.mark.parametrize("length", [6, 900])
def test_fennel_in_shards(spark, length):
    """More than a task may hold: many components in shards, or blocks of one that is too large; the load is kept."""
    nodes = list(range(900))
    pairs = [(a, a + 1) for a in nodes[:-1] if (a + 1) % length]
    g = Graph(spark.createDataFrame([e for a, b in pairs for e in ((a, b), (b, a))], "src long, dst long"), spark.createDataFrame([(v,) for v in [*nodes, 2000]], "id long"))
    for k, load in ((5, 1.1), (3, 1.005)):
        got = {r.id: r.cluster for r in partition.fennel(g, k, load=load, most=400).collect()}
        sizes = pd.Series(got.values()).value_counts()
        assert sorted(got) == [*nodes, 2000] and set(sizes.index) == set(range(k)) and sizes.max() <= load * 901 / k
        assert np.mean([got[a] != got[b] for a, b in pairs]) < 0.35
    again = partition.fennel(g, 5, start=spark.createDataFrame(list(got.items()), "id long, cluster long"), passes=2, most=400)
    assert again.count() == 901 and again.groupBy("cluster").count().agg({"count": "max"}).first()[0] <= 1.1 * 901 / 5


def hidden_patches(rng, dim=3, n=12, size=60):
    """A path of patches with a hub, each under its own scale, rotation and translation."""
    cloud = rng.normal(size=(n * 44 + 100, dim))
    members = [set(range(44 * i, 44 * i + size)) for i in range(n)]
    edges = [(i, i + 1) for i in range(n - 1)]
    for i in range(2, n, 3):
        members[0] |= set(range(44 * i, 44 * i + 16))
        edges.append((0, i))
    rows = []
    for p, nodes in enumerate(members):
        q, _ = np.linalg.qr(rng.normal(size=(dim, dim)))
        s, t = rng.uniform(0.5, 2), rng.normal(size=dim)
        rows += [(k, p, (s * cloud[k] @ q + t).tolist()) for k in sorted(nodes)]
    return cloud, rows, edges


@pytest.mark.parametrize("levels", [False, True])
def test_alignment_recovers_hidden_transforms(spark, levels):
    cloud, rows, edges = hidden_patches(np.random.default_rng(3))
    coords, e = spark.createDataFrame(rows, "node long, patch long, coord array<double>"), spark.createDataFrame(edges, "i long, j long")
    if levels:
        rows = [(k, p, c) for k, p, c in rows]
        coords = align.aligned(coords, e, 3, rotate=False, translate=False)  # inner levels leave scales alone
        clusters = spark.createDataFrame([(p, p // 4) for p in range(12)], "patch long, cluster long")
        path = spark.createDataFrame([x for x in edges if x[0] != 0 or x[1] == 1], "i long, j long")
        got = align.aligned_by_levels(coords, path, clusters, 3)
    else:
        got = align.mean_coords(align.aligned(coords, e, 3))
    got = got.toPandas().sort_values("node")
    have, want = np.array(got.ref.tolist()), cloud[got.node.to_numpy()]
    s, g, t = align.procrustes(want, have, scale=True)
    assert np.abs(s * have @ g + t - want).max() < 1e-6


def test_alignment_errors():
    stats = pd.DataFrame({"i": [0], "j": [1], "n": [2]})
    with pytest.raises(ValueError):
        align.solve(stats, 3)
    with pytest.raises(ValueError):
        align._connected(np.array([0, 2]), np.array([1, 3]), 4)


def test_temporal_and_windowed_errors_vanish_for_rigid_motion(spark):
    rng = np.random.default_rng(4)
    cloud, rows = rng.normal(size=(30, 2)), []
    for p in range(4):
        q, _ = np.linalg.qr(rng.normal(size=(2, 2)))
        rows += [(k, p, (cloud[k] @ q + p).tolist()) for k in range(30) if (k + p) % 7]
    coords = spark.createDataFrame(rows, "node long, patch long, coord array<double>")
    assert align.temporal_errors(coords, [0, 1, 2, 3], 2).agg(F.max("err")).first()[0] < 1e-8
    got = align.windowed_errors(coords, 3, 2)
    assert got.agg(F.max("err")).first()[0] < 1e-8 and {r.patch for r in got.collect()} == {2, 3}


def test_svd_is_orthogonal_and_has_no_trivial_pair():
    a = np.zeros((7, 6))
    rng = np.random.default_rng(5)
    a[:4, :3], a[4:, 3:] = rng.random((4, 3)) + 0.1, rng.random((3, 3)) + 0.1
    u, s, v = embed.svd_embedding(a, 3)
    r, c = a.sum(axis=1), a.sum(axis=0)
    assert np.allclose(u.T @ (r[:, None] * u), np.eye(3)) and np.allclose(v.T @ (c[:, None] * v), np.eye(3))
    assert np.allclose(r @ u, 0) and abs(s[-1] - 1) < 1e-9 and (np.diff(s) >= 0).all()
    with pytest.raises(ValueError):
        embed.svd_embedding(a, 6)


def test_gae_gradient():
    rng = np.random.default_rng(6)
    e = np.array([(0, 1), (1, 2), (2, 3), (3, 0), (1, 0), (2, 1), (3, 2), (0, 3)])
    neg = np.array([(0, 2), (1, 3)])
    a, x, w = embed.normalised_adjacency(4, e), np.eye(4), [rng.normal(size=(4, 3)), rng.normal(size=(3, 2))]
    _, grads, _ = embed.gae_loss(a, x, w, e, neg)
    for k in (0, 1):
        for i in np.ndindex(w[k].shape):
            w[k][i] += 1e-6
            up = embed.gae_loss(a, x, w, e, neg)[0]
            w[k][i] -= 2e-6
            down = embed.gae_loss(a, x, w, e, neg)[0]
            w[k][i] += 1e-6
            assert abs((up - down) / 2e-6 - grads[k][i]) < 1e-5


def test_stream_equals_batch(spark, tmp_path):
    from tessera.streaming.adjacency import daily_adjacency

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "user_id", "event_type")
    events.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = daily_adjacency(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("days").start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.sql("SELECT * FROM days").collect()}
    assert got == {tuple(r) for r in tables.daily_flows(spark, "/root/testdata/sf0.001").select("day", "src", "dst", "weight").collect()}


def test_isolation_forest_finds_the_outlier(spark):
    from tessera.operators.anomaly import isolation_forest

    rng = np.random.default_rng(7)
    rows = [(n, p, (rng.normal(size=3) + (9 if (n, p) in ((1, 4), (2, 20)) else 0)).tolist()) for n in (1, 2) for p in range(40)] + [(3, 0, [1.0, 2.0, 3.0])]
    got = isolation_forest(spark.createDataFrame(rows, "node long, patch long, coord array<double>")).toPandas()
    assert len(got) == 81
    top = got.loc[got[got.node < 3].groupby("node").score.idxmax()]
    assert list(zip(top.node, top.patch, strict=True)) == [(1, 4), (2, 20)]
