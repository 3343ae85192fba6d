"""Queries over the warehouse tables for the graph, anomaly and scoring operators, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import anomaly, score
from tessera.operators.graph import Graph, rolling_window_graph
from tessera.plans.iterate import kept
from tessera.sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def six(name: str):
    return F.round(name, 6).alias(name)


# ---- data --------------------------------------------------------------------------------------

_PART_CO = "pc AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b USING (l_orderkey) WHERE a.l_partkey <> b.l_partkey)"
_SUPP_CO = "o AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), sc AS (SELECT a.l_suppkey AS src, b.l_suppkey AS dst, count(*)::DOUBLE AS weight FROM o a JOIN o b USING (l_orderkey) WHERE a.l_suppkey <> b.l_suppkey GROUP BY 1, 2)"
_LINES = "ln AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS n FROM lineitem), th AS (SELECT a.o * 8 + a.n AS src, b.o * 8 + b.n AS dst FROM ln a JOIN ln b ON a.o = b.o AND abs(a.n - b.n) = 1), isl AS (SELECT o * 8 + n AS id, o, n, n - row_number() OVER (PARTITION BY o ORDER BY n) AS g FROM ln)"
_FLOWS = "fl AS (SELECT strftime(ts, '%Y-%m-%d') AS day, user_id AS src, event_type AS dst, count(*)::DOUBLE AS weight FROM events GROUP BY ALL)"
#: A user's day as five numbers: its normalised flow to each event type, 0 where there is none.
_COORDS = f"""{_FLOWS},
r AS (SELECT day, src, sum(weight) AS r FROM fl GROUP BY ALL), c AS (SELECT day, dst, sum(weight) AS c FROM fl GROUP BY ALL),
ty AS (SELECT DISTINCT dst FROM fl), cell AS (SELECT r.day, r.src, ty.dst, coalesce(fl.weight / sqrt(r.r * c.c), 0) AS v FROM r CROSS JOIN ty LEFT JOIN c ON c.day = r.day AND c.dst = ty.dst LEFT JOIN fl ON fl.day = r.day AND fl.src = r.src AND fl.dst = ty.dst),
p AS (SELECT day, dense_rank() OVER (ORDER BY day) - 1 AS patch FROM (SELECT DISTINCT day FROM fl)),
x AS (SELECT cell.src AS node, p.patch, cell.dst AS k, cell.v FROM cell JOIN p USING (day)),
ref AS (SELECT node, k, avg(v) AS m FROM x GROUP BY ALL),
e AS (SELECT x.node, x.patch, sqrt(sum((x.v - ref.m) * (x.v - ref.m))) AS err FROM x JOIN ref USING (node, k) GROUP BY x.node, x.patch)"""


def _coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(node, patch, coord)``: users by day, a number for each event type in order."""
    flows = T.daily_flows(spark, sf_dir)
    types = [r.dst for r in flows.select("dst").distinct().orderBy("dst").collect()]  # a handful of event types
    rows = flows.groupBy("day", "src").agg(F.sum("weight").alias("r"), *(F.sum(F.when(F.col("dst") == t, F.col("weight"))).alias(f"w{k}") for k, t in enumerate(types)))
    # Column sums come from the rows: a day's few sums are joined back, and days are few.
    sums = rows.groupBy("day").agg(*(F.sum(f"w{k}").alias(f"c{k}") for k in range(len(types))))
    days = sums.join(_day_numbers(rows), "day")
    cells = [F.coalesce(F.col(f"w{k}") / F.sqrt(F.col("r") * F.col(f"c{k}")), F.lit(0.0)) for k in range(len(types))]
    return rows.join(F.broadcast(days), "day").select(F.col("src").alias("node"), "patch", F.array(*cells).alias("coord"))


def _day_numbers(rows: DataFrame) -> DataFrame:
    from pyspark.sql.window import Window

    return rows.select("day").distinct().withColumn("patch", (F.row_number().over(Window.orderBy("day")) - 1).cast("long"))


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    coords = _coords(spark, sf_dir)
    return anomaly.local_errors(coords, anomaly.mean_coords(coords))


# ---- temporal anomaly ---------------------------------------------------------------------------


@query(f"""WITH {_COORDS},
o AS (SELECT a.node, a.patch, a.err, avg(b.err) AS m, stddev_pop(b.err) AS s FROM e a LEFT JOIN e b ON a.node = b.node AND a.patch <> b.patch GROUP BY ALL)
SELECT node, patch, round(err, 6) AS err, round((err - m) / (s + 1e-16), 6) AS score FROM o""")
def temporal_loo_z(spark, sf_dir):
    return anomaly.leave_one_out_z(_errors(spark, sf_dir)).select("node", "patch", six("err"), six("score"))


@query(f"WITH {_COORDS} SELECT node, patch, round((err - avg(err) OVER w) / (stddev_pop(err) OVER w + 1e-16), 6) AS score FROM e WINDOW w AS (PARTITION BY node)")
def z_score(spark, sf_dir):
    return anomaly.z_score(_errors(spark, sf_dir)).select("node", "patch", six("score"))


@query(f"WITH {_COORDS} SELECT a.node, a.patch, round(a.err / (sqrt(avg(b.err * b.err)) + 1e-16), 6) AS score FROM e a LEFT JOIN e b ON a.node = b.node AND a.patch <> b.patch GROUP BY a.node, a.patch, a.err")
def loo_rms(spark, sf_dir):
    return anomaly.leave_one_out_rms(_errors(spark, sf_dir)).select("node", "patch", six("score"))


@query(f"""WITH {_COORDS}, z AS (SELECT *, (err - avg(err) OVER w) / (stddev_pop(err) OVER w + 1e-16) AS z FROM e WINDOW w AS (PARTITION BY node)),
k AS (SELECT node, avg(err) AS m, stddev_pop(err) AS s FROM z WHERE z <= 1.5 GROUP BY node)
SELECT node, patch, round((err - m) / (s + 1e-16), 6) AS score FROM z JOIN k USING (node)""")
def boosted_z(spark, sf_dir):
    return anomaly.boosted_z(_errors(spark, sf_dir), threshold=1.5).select("node", "patch", six("score"))


@query(f"WITH {_COORDS}, q AS (SELECT node, median(err) AS m, quantile_cont(err, 0.75) AS q FROM e GROUP BY node) SELECT node, patch, round((err - m) / q, 6) AS score FROM e JOIN q USING (node)")
def quantile_score(spark, sf_dir):
    return anomaly.quantile_score(_errors(spark, sf_dir)).select("node", "patch", six("score"))


@query(f"WITH {_COORDS}, q AS (SELECT node, median(err) AS m, quantile_cont(err, 0.75) - quantile_cont(err, 0.25) AS q FROM e GROUP BY node) SELECT node, patch, round((err - m) / q, 6) AS score FROM e JOIN q USING (node)")
def iqr_score(spark, sf_dir):
    return anomaly.quantile_score(_errors(spark, sf_dir), [0.25, 0.75]).select("node", "patch", six("score"))


@query(f"""WITH {_COORDS}, np AS (SELECT count(*) AS n FROM p), d(rep, patch) AS (SELECT r, ('0x' || substr(md5(r::VARCHAR || ':' || p.patch::VARCHAR), 1, 6))::BIGINT % np.n FROM range(100) a(r), p, np),
s AS (SELECT e.node, d.rep, avg(e.err) AS m, stddev_pop(e.err) AS s FROM e JOIN d USING (patch) GROUP BY ALL), q AS (SELECT node, median(m) AS m, median(s) AS s FROM s GROUP BY node)
SELECT node, patch, round((err - m) / (s + 1e-16), 6) AS score FROM e JOIN q USING (node)""")
def bootstrap_z(spark, sf_dir):
    """100 samples of as many patches as there are."""
    errors = _errors(spark, sf_dir)
    patches = errors.select("patch").distinct()
    n = patches.count()
    draws = patches.select(F.explode(F.sequence(F.lit(0), F.lit(99))).alias("rep"), F.col("patch").alias("i"))
    draws = draws.select("rep", (F.conv(F.substring(F.md5(F.concat_ws(":", F.col("rep").cast("string"), F.col("i").cast("string"))), 1, 6), 16, 10).cast("long") % n).alias("patch"))
    return anomaly.bootstrap_z(errors, draws).select("node", "patch", six("score"))


@query(f"""WITH {_COORDS}, s AS (SELECT x.node, x.patch, x.k, x.v, avg(v) OVER (PARTITION BY node, k ORDER BY patch RANGE BETWEEN 6 PRECEDING AND CURRENT ROW) AS m FROM x)
SELECT node, patch, round(sqrt(sum((v - m) * (v - m))), 6) AS err FROM s WHERE patch >= 6 GROUP BY node, patch""")
def sliding_error(spark, sf_dir):
    return anomaly.sliding_errors(_coords(spark, sf_dir), 7).select("node", "patch", six("err"))


@query(f"WITH {_COORDS} SELECT node, list(round(m, 6) ORDER BY k) AS ref FROM ref GROUP BY node")
def mean_embedding(spark, sf_dir):
    return anomaly.mean_coords(_coords(spark, sf_dir)).select("node", F.transform("ref", lambda x: F.round(x, 6)).alias("ref"))


@query(f"WITH {_COORDS}, md AS (SELECT node, k, median(v) AS m FROM x GROUP BY ALL) SELECT node, list(round(m, 6) ORDER BY k) AS ref FROM md GROUP BY node")
def median_embedding(spark, sf_dir):
    return anomaly.median_coords(_coords(spark, sf_dir)).select("node", F.transform("ref", lambda x: F.round(x, 6)).alias("ref"))


@query(f"WITH {_COORDS} SELECT node, patch, round(err, 6) AS err FROM e")
def local_error(spark, sf_dir):
    return _errors(spark, sf_dir).select("node", "patch", six("err"))


@query(f"""WITH {_COORDS}, b AS (SELECT f.patch AS i, g.patch AS j, f.k, var_pop(f.v) AS va, var_pop(g.v) AS vb FROM x f JOIN x g ON f.node = g.node AND f.k = g.k AND f.patch < g.patch GROUP BY ALL)
SELECT i, j, round(sqrt(sum(va) / sum(vb)), 6) AS scale FROM b GROUP BY ALL""")
def relative_scale(spark, sf_dir):
    """Of every two days, over the users that both have."""
    from tessera.operators.align import relative_scale as run

    coords = _coords(spark, sf_dir)
    a, b = coords.select("node", F.col("patch").alias("i"), F.col("coord").alias("a")), coords.select("node", F.col("patch").alias("j"), F.col("coord").alias("b"))
    return run(a.join(b, "node").where("i < j"), "i", "j").select("i", "j", six("scale"))


@query(f"WITH {_COORDS}, m AS (SELECT DISTINCT node, patch FROM x) SELECT a.patch AS i, b.patch AS j, count(*) AS n FROM m a JOIN m b ON a.node = b.node AND b.patch > a.patch GROUP BY ALL")
def overlap_sizes(spark, sf_dir):
    """Users that every two days share; a user's days are few."""
    c = _coords(spark, sf_dir).select("node", "patch")
    return c.toDF("node", "i").join(c.toDF("node", "j"), "node").where("i < j").groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH x AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), d AS (SELECT a.label AS node, a.vec_id AS p, b.vec_id AS q, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d FROM x a JOIN x b ON a.label = b.label AND a.vec_id <> b.vec_id),
n AS (SELECT *, row_number() OVER (PARTITION BY node, p ORDER BY d, q) AS r FROM d QUALIFY r <= 10), k AS (SELECT node, p AS q, d AS kd FROM n WHERE r = 10),
l AS (SELECT node, p, 1 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM n JOIN k USING (node, q) GROUP BY ALL)
SELECT n.node, n.p AS patch, round(avg(b.lrd / a.lrd) - 1, 6) AS score FROM n JOIN l a ON a.node = n.node AND a.p = n.p JOIN l b ON b.node = n.node AND b.p = n.q GROUP BY ALL""")
def lof(spark, sf_dir):
    rows = T.table(spark, sf_dir, "embeddings").select(F.col("label").alias("node"), F.col("vec_id").alias("patch"), F.col("embedding").cast("array<double>").alias("coord"))
    return anomaly.local_outlier_factor(rows, 10).select("node", "patch", six("score"))


# ---- graphs -------------------------------------------------------------------------------------


@query("WITH l AS (SELECT l_suppkey * 2 AS a, l_partkey * 2 + 1 AS b FROM lineitem) SELECT a AS src, b AS dst FROM l UNION SELECT b, a FROM l")
def symmetrise(spark, sf_dir):
    return T.supplier_parts(spark, sf_dir).symmetrised().edges


@query(f"WITH {_SUPP_CO} SELECT src AS id, count(*) AS degree, sum(weight) AS strength FROM sc GROUP BY src")
def degree_strength(spark, sf_dir):
    return T.supplier_co_orders(spark, sf_dir).degrees()


@query("SELECT true AS undirected")
def is_undirected(spark, sf_dir):
    return T.supplier_co_orders(spark, sf_dir).is_undirected()


@query(f"WITH {_PART_CO} SELECT p_partkey AS src, p_partkey + 1 AS dst, EXISTS (SELECT 1 FROM pc WHERE pc.src = p_partkey AND pc.dst = p_partkey + 1) AS is_edge FROM part")
def edge_probe(spark, sf_dir):
    pairs = T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("src"), (F.col("p_partkey") + 1).alias("dst"))
    return T.part_co_orders(spark, sf_dir).probe(pairs)


_BRAND = "br AS (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 1), k AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_partkey) - 1 AS n FROM part WHERE p_brand = (SELECT p_brand FROM br))"


def _commonest_brand(spark, sf_dir) -> DataFrame:
    """``(id)`` of the parts of the commonest brand."""
    part = T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_brand")
    first = part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "p_brand").limit(1)
    return part.join(F.broadcast(first.select("p_brand")), "p_brand").select("id")


@query(f"WITH {_PART_CO}, {_BRAND} SELECT DISTINCT dst AS id FROM pc WHERE src IN (SELECT id FROM k)")
def neighbours(spark, sf_dir):
    """Of the parts of the commonest brand."""
    return T.part_co_orders(spark, sf_dir).neighbours(_commonest_brand(spark, sf_dir))


@query(f"WITH {_SUPP_CO} SELECT dst AS id, weight FROM sc WHERE src = (SELECT min(src) FROM sc)")
def adjacent(spark, sf_dir):
    """The first supplier's neighbours and weights."""
    g = T.supplier_co_orders(spark, sf_dir)
    return g.adjacent(g.nodes.agg(F.min("id")).first()[0] or 0)


@query(f"WITH {_LINES} SELECT id, row_number() OVER (ORDER BY id) - 1 AS position FROM isl")
def bfs_order(spark, sf_dir):
    """A chain's nodes come in order of their ids, and chains in order of their first."""
    return T.line_chains(spark, sf_dir).bfs_order()


@query(f"WITH {_LINES} SELECT id, (n - 1)::INT AS hop FROM isl WHERE g = 0 AND n <= 3")
def two_hop(spark, sf_dir):
    """Within two steps of the first lines."""
    g = T.line_chains(spark, sf_dir)
    return g.levels(g.nodes.where("id % 8 = 1"), 2)


@query(f"WITH {_LINES} SELECT id, (n - 1)::INT AS hop FROM isl WHERE g = 0")
def bfs_levels(spark, sf_dir):
    g = T.line_chains(spark, sf_dir)
    return g.levels(g.nodes.where("id % 8 = 1"))


@query(f"WITH {_PART_CO}, {_BRAND} SELECT a.n AS src, b.n AS dst FROM pc JOIN k a ON a.id = src JOIN k b ON b.id = dst")
def induced_subgraph(spark, sf_dir):
    """Of the parts of the commonest brand, relabelled."""
    return T.part_co_orders(spark, sf_dir).subgraph(_commonest_brand(spark, sf_dir), relabel=True).edges


_COMPONENTS = f"""WITH {_LINES}, m AS (SELECT id, min(id) OVER (PARTITION BY o, g) AS root FROM isl),
z AS (SELECT root, row_number() OVER (ORDER BY count(*) DESC, root) - 1 AS component FROM m GROUP BY root)"""


@query(f"{_COMPONENTS} SELECT id, component FROM m JOIN z USING (root)")
def components(spark, sf_dir):
    return T.line_chains(spark, sf_dir).components()


@query(f"{_COMPONENTS} SELECT src, dst FROM th JOIN m ON m.id = src JOIN z USING (root) WHERE component = 0")
def lcc(spark, sf_dir):
    return T.line_chains(spark, sf_dir).lcc().edges


def _mod_partition(spark, sf_dir) -> DataFrame:
    return T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 7).alias("cluster"))


@query(f"WITH {_PART_CO} SELECT src % 7 AS src, dst % 7 AS dst, count(*) AS weight FROM pc GROUP BY 1, 2")
def quotient_graph(spark, sf_dir):
    return T.part_co_orders(spark, sf_dir).quotient(_mod_partition(spark, sf_dir))


@query(f"WITH {_PART_CO} SELECT src % 7 AS src, dst % 7 AS dst, count(*) AS weight FROM pc WHERE src % 7 <> dst % 7 GROUP BY 1, 2")
def quotient_no_loops(spark, sf_dir):
    return T.part_co_orders(spark, sf_dir).quotient(_mod_partition(spark, sf_dir), self_loops=False)


@query(f"WITH {_PART_CO}, t AS (SELECT count(*) AS t FROM pc), c AS (SELECT src % 7 AS cluster, count(*) FILTER (src % 7 <> dst % 7) AS cut, count(*) AS d FROM pc GROUP BY 1) SELECT cluster, round(cut / least(d, t - d), 6) AS conductance FROM c, t")
def conductance(spark, sf_dir):
    return T.part_co_orders(spark, sf_dir).conductance(_mod_partition(spark, sf_dir)).select("cluster", six("conductance"))


@query(f"WITH {_PART_CO} SELECT round(count(*) FILTER (src % 7 = 0 AND dst % 7 = 1) / least(count(*) FILTER (src % 7 = 0), count(*) FILTER (src % 7 = 1)), 6) AS conductance FROM pc")
def conductance_between(spark, sf_dir):
    part = _mod_partition(spark, sf_dir)
    return T.part_co_orders(spark, sf_dir).conductance_between(part.where("cluster = 0"), part.where("cluster = 1")).select(six("conductance"))


@query(f"WITH {_SUPP_CO} SELECT (SELECT count(DISTINCT src) FROM sc) AS num_nodes, (SELECT count(*) FROM sc) AS num_edges, 0 AS num_features, true AS weighted, false AS has_labels")
def graph_metadata(spark, sf_dir):
    return T.supplier_co_orders(spark, sf_dir).metadata()


@query(f"WITH {_SUPP_CO}, s AS (SELECT src AS id, sum(weight) AS s FROM sc GROUP BY 1) SELECT src, dst, round(weight / least(a.s, b.s), 6) AS weight FROM sc JOIN s a ON a.id = src JOIN s b ON b.id = dst")
def conductance_weights(spark, sf_dir):
    return T.supplier_co_orders(spark, sf_dir).conductance_weights().edges.select("src", "dst", six("weight"))


@query(f"WITH {_SUPP_CO}, t AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM sc QUALIFY r <= 4) SELECT a.src, a.dst, a.weight FROM t a JOIN t b ON a.src = b.dst AND a.dst = b.src")
def mutual_knn(spark, sf_dir):
    return T.supplier_co_orders(spark, sf_dir).mutual_nearest(4).edges


#: Every two suppliers' best worst edge over all paths, as a rank of edges by weight (1 the heaviest), by Floyd's recursion.
_WIDEST = f"""{_SUPP_CO}, ids AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM (SELECT DISTINCT src AS id FROM sc)),
rk AS (SELECT src, dst, weight, row_number() OVER (ORDER BY weight DESC, src, dst) AS r FROM sc WHERE src < dst),
f0 AS (SELECT a.k AS i, b.k AS j, coalesce(rk.r, 1000000000) AS b FROM ids a CROSS JOIN ids b LEFT JOIN rk ON rk.src = least(a.id, b.id) AND rk.dst = greatest(a.id, b.id)),
fw AS (SELECT 0::BIGINT AS step, i, j, b FROM f0 UNION ALL SELECT f.step + 1, f.i, f.j, least(f.b, greatest(x.b, y.b)) FROM fw f JOIN fw x ON x.i = f.i AND x.j = f.step JOIN fw y ON y.i = f.step AND y.j = f.j WHERE f.step < (SELECT count(*) FROM ids)),
wide AS (SELECT a.id AS src, c.id AS dst, b FROM fw JOIN ids a ON a.k = i JOIN ids c ON c.k = j WHERE step = (SELECT count(*) FROM ids)),
tree AS (SELECT rk.src, rk.dst, weight FROM rk JOIN wide USING (src, dst) WHERE b = r)"""
_MUTUAL = "t AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM sc QUALIFY r <= 4), mu AS (SELECT a.src, a.dst, a.weight FROM t a JOIN t b ON a.src = b.dst AND a.dst = b.src)"


@query(f"WITH RECURSIVE {_WIDEST} SELECT src, dst, weight FROM tree")
def spanning_forest(spark, sf_dir):
    return T.supplier_co_orders(spark, sf_dir).heaviest_forest()


@query("WITH p AS (SELECT DISTINCT date_diff('day', (SELECT min(ts)::DATE FROM events), ts::DATE) AS d FROM events), q AS (SELECT row_number() OVER (ORDER BY d) - 1 AS p FROM p), o AS (SELECT unnest([1, 2, 3, 4, 5, 6]) AS o) SELECT a.p AS src, b.p AS dst FROM q a JOIN q b ON abs(a.p - b.p) IN (SELECT o FROM o)")
def rolling_patch_graph(spark, sf_dir):
    """The events' days, those less than a week apart linked."""
    return rolling_window_graph(_day_numbers(T.daily_flows(spark, sf_dir)).select("patch"), [1, 2, 3, 4, 5, 6])


@query(f"WITH {_PART_CO} SELECT DISTINCT src % 7 AS i, dst % 7 AS j, src AS node FROM pc WHERE src % 7 <> dst % 7")
def seed_nodes(spark, sf_dir):
    """Nodes of cluster i that are adjacent to cluster j."""
    part = _mod_partition(spark, sf_dir)
    edges = T.part_co_orders(spark, sf_dir).edges
    named = edges.join(part.toDF("src", "i"), "src").join(part.toDF("dst", "j"), "dst")
    return named.where("i <> j").select("i", "j", F.col("src").alias("node")).distinct()


# ---- evaluation ---------------------------------------------------------------------------------

_PAIRS = "v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS x FROM embeddings), pr AS (SELECT a.id AS src, b.id AS dst, (a.label = b.label)::INT AS label, list_dot_product(a.x, b.x) AS dot, sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS dist FROM v a JOIN v b ON b.id BETWEEN a.id + 1 AND a.id + 20)"


def _pairs(spark, sf_dir, by_distance: bool = False) -> DataFrame:
    rows = T.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("coord"))
    a = rows.select(F.col("id").alias("src"), F.col("label").alias("la"), F.explode(F.sequence(F.col("id") + 1, F.col("id") + 20)).alias("dst"))
    pairs = a.join(rows.select(F.col("id").alias("dst"), F.col("label").alias("lb")), "dst").select("src", "dst", (F.col("la") == F.col("lb")).cast("int").alias("label"))
    return score.pair_scores(pairs, rows.select("id", "coord"), by_distance)


@query(f"WITH {_PAIRS} SELECT src, dst, label, round(1 / (1 + exp(-dot)), 6) AS score FROM pr")
def pair_scores(spark, sf_dir):
    return _pairs(spark, sf_dir).select("src", "dst", "label", six("score"))


def _auc_sql(expr: str) -> str:
    return f"WITH {_PAIRS}, s AS (SELECT label, round({expr}, 9) AS score FROM pr), g AS (SELECT score, sum(label) AS p, sum(1 - label) AS n FROM s GROUP BY 1), c AS (SELECT p, n, sum(n) OVER (ORDER BY score) - n AS b FROM g) SELECT round((sum(p * (b + n / 2)) / (sum(p) * sum(n)))::DOUBLE, 6) AS auc FROM c"


@query(_auc_sql("1 / (1 + exp(-dot))"))
def auc_dot(spark, sf_dir):
    return score.roc_auc(_pairs(spark, sf_dir).select("label", F.round("score", 9).alias("score"))).select(six("auc"))


@query(_auc_sql("exp(-dist)"))
def auc_dist(spark, sf_dir):
    return score.roc_auc(_pairs(spark, sf_dir, True).select("label", F.round("score", 9).alias("score"))).select(six("auc"))


@query("""WITH h AS (SELECT vec_id AS id, label AS y, md5('0:' || vec_id::VARCHAR) AS h FROM embeddings), t AS (SELECT id, y, h, row_number() OVER (PARTITION BY y ORDER BY h, id) AS k FROM h),
r AS (SELECT id, row_number() OVER (ORDER BY h, id) AS k FROM t WHERE k > 20)
SELECT id, 'train' AS part FROM t WHERE k <= 20 UNION ALL SELECT id, CASE WHEN k <= 100 THEN 'val' ELSE 'test' END FROM r""")
def stratified_split(spark, sf_dir):
    return score.random_split(T.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("y")), 20, 100)


@query("""WITH x AS (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS k FROM embeddings), c AS (SELECT label AS c, k, avg(v::DOUBLE) AS m FROM x GROUP BY ALL),
d AS (SELECT vec_id, label, c.c, round(sum((x.v - m) * (x.v - m)), 9) AS d FROM x JOIN c USING (k) GROUP BY ALL), p AS (SELECT vec_id, label, row_number() OVER (PARTITION BY vec_id ORDER BY d, c) AS r, c FROM d)
SELECT label, round(avg((label = c)::INT), 6) AS accuracy FROM p WHERE r = 1 GROUP BY label""")
def accuracy(spark, sf_dir):
    """Of predictions by the nearest class centre."""
    rows = T.table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("k", "v"))
    centres = rows.groupBy(F.col("label").alias("c"), "k").agg(F.avg("v").alias("m"))
    d = rows.join(F.broadcast(centres), "k").groupBy("vec_id", "label", "c").agg(F.round(F.sum((F.col("v") - F.col("m")) * (F.col("v") - F.col("m"))), 9).alias("d"))
    p = d.groupBy("vec_id", "label").agg(F.min(F.struct("d", "c")).alias("x")).select(F.col("label").alias("y"), "label", F.col("x.c").alias("predicted"))
    return score.accuracy(p, "label").select("label", six("accuracy"))


@query("WITH x AS (SELECT vec_id, exp(unnest(embedding)::DOUBLE) AS e FROM embeddings), s AS (SELECT vec_id, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM x), h AS (SELECT vec_id, sum(-p * ln(p)) AS h FROM s GROUP BY 1) SELECT round(avg(h), 6) AS entropy FROM h")
def entropy(spark, sf_dir):
    rows = T.table(spark, sf_dir, "embeddings").select(F.transform("embedding", lambda x: F.exp(x.cast("double"))).alias("e"))
    rows = rows.withColumn("s", F.aggregate("e", F.lit(0.0), lambda a, x: a + x)).select(F.transform("e", lambda x: x / F.col("s")).alias("p"))
    return score.entropy(rows).select(six("entropy"))


def _results(spark, sf_dir) -> DataFrame:
    o = T.table(spark, sf_dir, "lineitem")
    return o.select((F.col("l_linenumber") * 2).alias("dim"), (F.col("l_orderkey") % 10).alias("run"), F.lit("auc").alias("key"), F.col("l_discount").alias("value"))


@query("SELECT l_linenumber * 2 AS dim, 'auc' AS key, round(avg(l_discount), 6) AS mean, round(stddev_samp(l_discount), 6) AS deviation FROM lineitem GROUP BY 1")
def results_mean_std(spark, sf_dir):
    return score.mean_and_deviation(_results(spark, sf_dir)).select("dim", "key", six("mean"), six("deviation"))


@query("WITH d AS (SELECT unnest([2, 4, 6, 99])::INT AS dim), r AS (SELECT l_linenumber * 2 AS dim, max(l_discount) AS b FROM lineitem GROUP BY 1) SELECT d.dim, coalesce(b, '-infinity'::DOUBLE) AS best FROM d LEFT JOIN r USING (dim)")
def results_best(spark, sf_dir):
    dims = spark.sql("SELECT * FROM VALUES (2), (4), (6), (99) AS d(dim)")
    return score.best(_results(spark, sf_dir), dims, "auc")


@query("WITH d AS (SELECT unnest([2, 4, 6, 99])::INT AS dim), r AS (SELECT l_linenumber * 2 AS dim, min(l_discount) AS b, count(DISTINCT l_orderkey % 10) AS n FROM lineitem GROUP BY 1) SELECT d.dim, coalesce(b, 'infinity'::DOUBLE) AS worst, coalesce(n, 0) AS runs, coalesce(n, 0) > 0 AS found FROM d LEFT JOIN r USING (dim)")
def results_worst(spark, sf_dir):
    r, dims = _results(spark, sf_dir), spark.sql("SELECT * FROM VALUES (2), (4), (6), (99) AS d(dim)")
    return score.worst(r, dims, "auc").join(score.runs(r, dims), "dim").join(score.has_dim(r, dims), "dim")


# ---- patch graphs, partitions, alignment --------------------------------------------------------


@query("SELECT unnest(range(n_nationkey, n_nationkey * 2))::BIGINT AS value FROM nation")
def multi_arange(spark, sf_dir):
    from tessera.operators.thin import multi_arange as run

    n = T.table(spark, sf_dir, "nation")
    return run(n.select(F.col("n_nationkey").cast("long").alias("start"), (F.col("n_nationkey") * 2).cast("long").alias("stop")))


@query(f"""WITH {_PART_CO}, m AS (SELECT p_partkey AS node, p_partkey % 7 AS patch FROM part UNION SELECT p_partkey, (p_partkey % 7 + 1) % 7 FROM part WHERE p_partkey % 3 = 0)
SELECT round(count(*) / (SELECT count(*) FROM pc), 6) AS ratio FROM pc JOIN m a ON a.node = src JOIN m b ON b.node = dst AND b.patch = a.patch""")
def oversampling_ratio(spark, sf_dir):
    from tessera.operators.partition import oversampling_ratio as run

    own = _mod_partition(spark, sf_dir).select(F.col("cluster").alias("patch"), F.col("id").alias("node"))
    more = own.where("node % 3 = 0").select(((F.col("patch") + 1) % 7).alias("patch"), "node")
    return run(T.part_co_orders(spark, sf_dir), own.unionByName(more).distinct()).select(six("ratio"))


_STEP = "SELECT id, seed, sum(v) AS v FROM (SELECT id, seed, v / 2 AS v FROM x{a} UNION ALL SELECT w.dst, seed, w.w * v FROM x{a} JOIN w ON w.src = x{a}.id) GROUP BY ALL"


@query(f"""WITH {_SUPP_CO}, s AS (SELECT src AS id, sum(weight) AS s FROM sc GROUP BY 1), w AS (SELECT src, dst, weight / sqrt(a.s * b.s) / 2 AS w FROM sc JOIN s a ON a.id = src JOIN s b ON b.id = dst),
x0 AS (SELECT id, id AS seed, 1 / sqrt(s) AS v FROM s WHERE id % 20 = 3), x1 AS ({_STEP.format(a=0)}), x2 AS ({_STEP.format(a=1)}), x3 AS ({_STEP.format(a=2)})
SELECT id, arg_max(seed, (round(v, 12), -seed)) AS cluster FROM x3 GROUP BY id""")
def diffusion_clusters(spark, sf_dir):
    from tessera.operators.partition import diffusion
    from tessera.plans.iterate import release

    g = Graph(kept(T.supplier_co_orders(spark, sf_dir).edges.sortWithinPartitions("src", "dst")))  # a node's edges together take little room
    release(spark)
    return diffusion(g, g.nodes.where("id % 20 = 3"), 3)


def _invariants(graph: Graph, sparse: Graph) -> DataFrame:
    """One row: directed edges, whether they are symmetric and the graph's own, and components."""
    edges = sparse.weights()
    own = edges.join(graph.weights(), ["src", "dst", "weight"], "left_semi").agg(F.count(F.lit(1)).alias("own"))
    both = edges.join(edges.toDF("dst", "src", "weight"), ["src", "dst", "weight"], "left_semi").agg(F.count(F.lit(1)).alias("both"))
    parts = Graph(sparse.edges, graph.nodes).components().agg(F.countDistinct("component").alias("components"))
    one = edges.agg(F.count(F.lit(1)).alias("n_edges")).join(F.broadcast(own)).join(F.broadcast(both)).join(F.broadcast(parts))
    return one.select("n_edges", (F.col("own") == F.col("n_edges")).alias("own"), (F.col("both") == F.col("n_edges")).alias("symmetric"), "components")


_SPARSE = f"WITH {_SUPP_CO}, n AS (SELECT count(DISTINCT src) AS n, count(*) AS e FROM sc) SELECT least(2 * (4 * n // 2), e)::BIGINT AS n_edges, true AS own, true AS symmetric, 1::BIGINT AS components FROM n"


@query(_SPARSE)
def resistance_sparsified(spark, sf_dir):
    """What holds of any draw: its size, own edges, symmetry, connectedness."""
    from tessera.operators.thin import resistance_sparsify

    g = Graph(kept(T.supplier_co_orders(spark, sf_dir).edges))
    return _invariants(g, resistance_sparsify(g))


@query(_SPARSE)
def sample_sparsified(spark, sf_dir):
    from tessera.operators.thin import sample_sparsify

    g = Graph(kept(T.supplier_co_orders(spark, sf_dir).edges))
    return _invariants(g, sample_sparsify(g))


@query("SELECT 200::BIGINT AS n, 0::BIGINT AS edges, 0::BIGINT AS loops")
def negative_samples(spark, sf_dir):
    """How many of 200 drawn pairs are edges, or no pairs."""
    g = T.line_chains(spark, sf_dir)
    found = g.probe(g.sample_negative(200, 3))
    return found.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("is_edge"), 1)).alias("edges"), F.count(F.when(F.expr("src = dst"), 1)).alias("loops"))


@query("SELECT 200::BIGINT AS n, 200::BIGINT AS edges")
def positive_samples(spark, sf_dir):
    g = T.line_chains(spark, sf_dir)
    return g.probe(g.sample_positive(200, 3)).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("is_edge"), 1)).alias("edges"))


@query(f"WITH RECURSIVE {_WIDEST}, {_MUTUAL} SELECT src, dst, weight FROM mu UNION SELECT src, dst, weight FROM tree UNION SELECT dst, src, weight FROM tree")
def neighbour_sparsified(spark, sf_dir):
    from tessera.operators.thin import neighbour_sparsify

    return neighbour_sparsify(T.supplier_co_orders(spark, sf_dir)).edges


@query(f"""WITH RECURSIVE {_WIDEST}, best AS (SELECT src AS id, max(weight) AS d FROM sc GROUP BY 1)
SELECT sc.src, sc.dst, sc.weight FROM sc JOIN wide ON wide.src = sc.src AND wide.dst = sc.dst JOIN rk ON rk.r = wide.b JOIN best a ON a.id = sc.src JOIN best b ON b.id = sc.dst
WHERE sc.weight >= rk.weight OR rk.weight - 0.01::DOUBLE * (a.d + b.d) < sc.weight""")
def relaxed_tree(spark, sf_dir):
    from tessera.operators.thin import relaxed_tree as run

    return run(T.supplier_co_orders(spark, sf_dir), gamma=0.01).edges


def _covers(found: DataFrame, cap) -> DataFrame:
    """One row: nodes, clusters, nodes without one, and whether the largest cluster is within ``cap`` (of the node count)."""
    sizes = found.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    one = sizes.agg(F.sum("n").alias("nodes"), F.count("cluster").alias("clusters"), F.coalesce(F.sum(F.when(F.col("cluster").isNull(), F.col("n"))), F.lit(0)).alias("free"), F.max("n").alias("largest"))
    return one.select("nodes", "clusters", "free", (F.col("largest") <= cap(F.col("nodes"))).alias("balanced"))


@query(f"WITH {_LINES} SELECT count(*) AS nodes, 5::BIGINT AS clusters, 0::BIGINT AS free, true AS balanced FROM ln")
def fennel_clusters(spark, sf_dir):
    """Whether all nodes have a cluster, and none is too large."""
    from tessera.operators.partition import fennel

    return _covers(fennel(T.line_chains(spark, sf_dir), 5), lambda n: 1.1 * n / 5)


@query(f"WITH {_PART_CO} SELECT count(DISTINCT src) AS nodes, 7::BIGINT AS clusters, 0::BIGINT AS free, true AS balanced FROM pc")
def kway_clusters(spark, sf_dir):
    from tessera.operators.cluster import kway

    return _covers(kway(Graph(kept(T.part_co_orders(spark, sf_dir).edges)), 7), lambda n: F.ceil(1.05 * n / 7))


@query(f"WITH {_LINES} SELECT count(DISTINCT (o, g)) AS clusters, 0::BIGINT AS \"across\" FROM isl WHERE n > 0")
def louvain_clusters(spark, sf_dir):
    """Chains of up to seven lines are cut into clusters, none of which holds nodes of two chains: no fewer clusters than chains
    are counted as many, and edges between components as none."""
    from tessera.operators.cluster import louvain

    g = T.line_chains(spark, sf_dir)
    both = louvain(g).join(g.components(), "id")
    mixed = both.groupBy("cluster").agg(F.countDistinct("component").alias("k")).where("k > 1").agg(F.count(F.lit(1)).alias("across"))
    return both.agg(F.countDistinct("component").alias("clusters")).join(F.broadcast(mixed)).select("clusters", "across")


def _round(k: int) -> str:
    return f"v{k} AS (SELECT src AS id, cluster, sum(weight) AS w FROM sc JOIN l{k} ON l{k}.id = dst GROUP BY ALL), l{k + 1} AS (SELECT id, arg_max(cluster, (w, -cluster)) AS cluster FROM v{k} GROUP BY id)"


@query(f"WITH {_SUPP_CO}, l0 AS (SELECT DISTINCT src AS id, src AS cluster FROM sc), {', '.join(_round(k) for k in range(5))} SELECT id, cluster FROM l5")
def label_clusters(spark, sf_dir):
    from tessera.operators.partition import label_propagation

    return label_propagation(T.supplier_co_orders(spark, sf_dir), 5)


@query(f"WITH {_LINES} SELECT count(*) AS nodes, true AS large, 0::BIGINT AS split FROM ln")
def merged_clusters(spark, sf_dir):
    """Whether clusters are large enough, and none of those given is split."""
    from tessera.operators.partition import merge_small

    g = T.line_chains(spark, sf_dir)
    given = g.nodes.select("id", F.floor(F.sqrt(F.floor(F.col("id") / 8))).alias("cluster"))
    both = merge_small(g, given, 500).join(given.withColumnRenamed("cluster", "was"), "id")
    split = both.groupBy("was").agg(F.countDistinct("cluster").alias("k")).where("k > 1").agg(F.count(F.lit(1)).alias("split"))
    return both.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("nodes"), (F.min("n") >= 500).alias("large")).join(F.broadcast(split)).select("nodes", "large", "split")


@query(f"""WITH {_PART_CO}, se AS (SELECT DISTINCT src % 7 AS i, dst % 7 AS j, src AS node FROM pc WHERE (src % 7 + 1) % 7 = dst % 7 OR (dst % 7 + 1) % 7 = src % 7),
k AS (SELECT j, node, row_number() OVER (PARTITION BY i, j ORDER BY md5('0:' || node::VARCHAR), node) AS r FROM se)
SELECT p_partkey % 7 AS patch, p_partkey AS node FROM part UNION SELECT j, node FROM k WHERE r <= 20""")
def overlapping_patches(spark, sf_dir):
    """Neighbours in a ring of seven clusters; each gives nodes enough next to the other, so that no hop is needed."""
    from tessera.operators.partition import overlapping_patches as run

    part = _mod_partition(spark, sf_dir)
    pairs = spark.range(7).select(F.col("id").alias("i"), F.explode(F.array(F.lit(1), F.lit(6))).alias("o")).select("i", ((F.col("i") + F.col("o")) % 7).alias("j"))
    return run(T.part_co_orders(spark, sf_dir), part, pairs, 10, 40)


@query(f"WITH {_FLOWS}, n AS (SELECT DISTINCT day FROM fl) SELECT day, k, l, (k = l)::INT::DOUBLE AS product, 0::DOUBLE AS trivial FROM n, range(2) a(k), range(2) b(l)")
def svd_patches(spark, sf_dir):
    """Every day's user vectors: their products under the users' weights are 0 and 1, and that with the trivial vector is 0."""
    from tessera.operators.embed import svd_patches as run

    flows = T.daily_flows(spark, sf_dir)
    r = flows.groupBy("day", F.col("src").cast("string").alias("node")).agg(F.sum("weight").alias("r"))
    u = run(flows, 2).where("side = 'src'").join(r, ["day", "node"])
    sums = u.groupBy("day").agg(*(F.sum(F.col("r") * F.col("coord")[k] * F.col("coord")[q]).alias(f"p{k}{q}") for k in (0, 1) for q in (0, 1)), *(F.sum(F.col("r") * F.col("coord")[k]).alias(f"t{k}") for k in (0, 1)))
    rows = F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("k"), F.lit(q).cast("long").alias("l"), F.abs(F.round(f"p{k}{q}", 5)).alias("product"), F.abs(F.round(f"t{k}", 5)).alias("trivial")) for k in (0, 1) for q in (0, 1))))
    return sums.select("day", rows.alias("x")).select("day", "x.*")


def _rolling_edges(spark, coords: DataFrame, window: int) -> DataFrame:
    patches = coords.select("patch").distinct()
    return rolling_window_graph(patches, list(range(1, window))).where("src < dst").select(F.col("src").alias("i"), F.col("dst").alias("j"))


def _hidden(spark, sf_dir) -> DataFrame:
    """``(node, patch, coord)``: users at their mean coordinates on each of their days, all days' axes turned, stretched and
    shifted by the day; after alignment they must fall together."""
    coords = _coords(spark, sf_dir)
    at = coords.select("node", "patch").join(anomaly.mean_coords(coords), "node")
    turn, size = F.col("patch") * 0.7, 1 + F.col("patch") / 10
    x = [F.col("ref")[k] for k in range(5)]
    moved = [F.cos(turn) * x[0] - F.sin(turn) * x[3], x[1], F.cos(2 * turn) * x[2] - F.sin(2 * turn) * x[4], F.sin(turn) * x[0] + F.cos(turn) * x[3], F.sin(2 * turn) * x[2] + F.cos(2 * turn) * x[4]]
    return at.select("node", "patch", F.array(*(size * v + F.col("patch") * (k + 1) for k, v in enumerate(moved))).alias("coord"))


def _fallen(errors: DataFrame) -> DataFrame:
    return errors.select("node", "patch", F.abs(F.round("err", 4)).alias("err"))


@query(f"WITH {_COORDS} SELECT node, patch, 0::DOUBLE AS err FROM e")
def align_global(spark, sf_dir):
    """Distance of each user's day from its mean over all days after aligning hidden transforms away."""
    from tessera.operators.align import aligned

    coords = _hidden(spark, sf_dir)
    moved = aligned(coords, _rolling_edges(spark, coords, 4), 5)
    return _fallen(anomaly.local_errors(moved, anomaly.mean_coords(moved)))


@query(f"WITH {_COORDS}, w AS (SELECT DISTINCT node, patch // 7 AS patch FROM e), f AS (SELECT min(patch) AS first FROM w) SELECT w.node, w.patch, 0::DOUBLE AS err FROM w, f WHERE w.patch = first OR EXISTS (SELECT 1 FROM w v WHERE v.node = w.node AND v.patch < w.patch)")
def align_temporal(spark, sf_dir):
    """Week after week of hidden transforms against the mean of the weeks before."""
    from tessera.operators.align import temporal_errors

    coords = _coords(spark, sf_dir)
    weeks = coords.select("node", F.floor(F.col("patch") / 7).alias("patch")).distinct()
    rows = weeks.join(anomaly.mean_coords(coords), "node").select("node", "patch", F.transform("ref", lambda x: (1 + F.col("patch")) * x + F.col("patch")).alias("coord"))
    return _fallen(temporal_errors(rows, [r.patch for r in rows.select("patch").distinct().orderBy("patch").collect()], 5))


@query(f"WITH {_COORDS} SELECT node, patch, 0::DOUBLE AS err FROM e WHERE patch >= 6")
def align_windowed(spark, sf_dir):
    """Each day against the week that it ends, hidden transforms aligned away jointly."""
    from tessera.operators.align import windowed_errors

    return _fallen(windowed_errors(_hidden(spark, sf_dir), 7, 5))


@query(f"WITH {_SUPP_CO} SELECT count(DISTINCT src) AS nodes, true AS finite, 4 AS width FROM sc")
def gae_embedding(spark, sf_dir):
    """Whether every supplier has coordinates that are numbers."""
    return _embedded(spark, sf_dir, "gae")


@query(f"WITH {_SUPP_CO} SELECT count(DISTINCT src) AS nodes, true AS finite, 4 AS width FROM sc")
def vgae_embedding(spark, sf_dir):
    return _embedded(spark, sf_dir, "vgae")


@query(f"WITH {_SUPP_CO} SELECT count(DISTINCT src) AS nodes, true AS finite, 4 AS width FROM sc")
def dgi_embedding(spark, sf_dir):
    return _embedded(spark, sf_dir, "dgi")


def _embedded(spark, sf_dir, model: str) -> DataFrame:
    from tessera.operators.neural import train_patches

    edges = T.supplier_co_orders(spark, sf_dir).edges.withColumn("patch", F.lit(0).cast("long"))
    got = train_patches(edges, 4, model, epochs=30)
    fine = F.forall("coord", lambda x: ~F.isnan(x) & (F.abs(x) < 1e6))
    return got.agg(F.count(F.lit(1)).alias("nodes"), F.min(fine).alias("finite"), F.max(F.size("coord")).alias("width"))


@query(f"WITH {_COORDS} SELECT node, patch, true AS inside FROM e")
def isolation_forest(spark, sf_dir):
    """Whether every score lies between 0 and 1."""
    return anomaly.isolation_forest(_coords(spark, sf_dir)).select("node", "patch", F.expr("score >= 0 and score <= 1").alias("inside"))


@query("SELECT 'test_accuracy' AS key, true AS good UNION ALL SELECT 'val_accuracy', true")
def classifier_search(spark, sf_dir):
    """Whether the best of a grid of classifiers learns the quarter that an embedding's first two numbers lie in."""
    from tessera.operators import classify

    rows = T.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("coord"))
    labels = rows.select("id", F.expr("cast(coord[0] > 0 as long) + 2 * cast(coord[1] > 0 as long)").alias("y"))
    found = classify.ranked(classify.search(classify.problem(rows.select("id", "coord"), labels, score.random_split(labels, 60, 100)), classify.grid(kind=["logistic", "mlp"], hidden=16, epochs=300, lr=[0.2, 0.5], decay=0.001))).limit(1)
    keys = F.explode(F.array(*(F.struct(F.lit(k).alias("key"), (F.col(k) > 0.5).alias("good")) for k in ("val_accuracy", "test_accuracy"))))
    return found.select(keys.alias("x")).select("x.*")


@query(f"""WITH {_COORDS}, u AS (SELECT 'src' AS side, node::VARCHAR AS node, patch FROM e UNION ALL SELECT DISTINCT 'dst', dst, patch FROM fl JOIN p USING (day))
SELECT side, node, patch, true AS fine FROM u WHERE patch >= 6""")
def temporal_pipeline(spark, sf_dir):
    """The whole temporal run over the events: which nodes and days have an error."""
    import uuid

    from tessera.plans.iterate import shared_dir
    from tessera.plans.stages import temporal_pipeline as run

    got = run(spark, T.daily_flows(spark, sf_dir), f"{shared_dir(spark)}/temporal-{uuid.uuid4().hex}", dim=2, window=7)
    return got.select("side", "node", "patch", (F.col("err") >= 0).alias("fine"))


@query("SELECT 2 AS dim, 0::BIGINT AS run, 'auc' AS key, true AS inside")
def static_pipeline(spark, sf_dir):
    """The whole static run over the parts' graph, with few epochs: whether it ends in an area under the curve."""
    import uuid

    from tessera.plans.iterate import release, shared_dir
    from tessera.plans.stages import static_pipeline as run

    edges = T.part_co_orders(spark, sf_dir).edges.sortWithinPartitions("src", "dst")  # a node's edges together take little room
    graph = Graph(kept(edges))
    graph = Graph(graph.edges, kept(graph.nodes))
    release(spark)
    got = run(spark, graph, f"{shared_dir(spark)}/static-{uuid.uuid4().hex}", epochs=10, runs=1, clusters=7, sparsify="sample", baseline=False, lr=0.01)
    return got.select("dim", "run", "key", F.expr("value > 0 and value < 1").alias("inside"))
