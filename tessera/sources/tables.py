"""Graphs and temporal data derived from the warehouse tables, and graph folders on disk."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.graph import Graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(day, src, dst, weight)``: events of a user by type and day; repeated cells are summed."""
    events = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("user_id").alias("src"), F.col("event_type").alias("dst"))
    return events.groupBy("day", "src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def supplier_parts(spark: SparkSession, sf_dir: str) -> Graph:
    """Suppliers (even ids) and the parts that they shipped (odd ids), directed."""
    lines = table(spark, sf_dir, "lineitem")
    return Graph(lines.select((F.col("l_suppkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst")).distinct())


def part_co_orders(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts that share an order, both directions, unweighted."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    other = lines.withColumnRenamed("l_partkey", "dst")
    pairs = lines.withColumnRenamed("l_partkey", "src").join(other, "l_orderkey").where("src <> dst").select("src", "dst").repartition("src").distinct()
    return Graph(pairs)


def supplier_co_orders(spark: SparkSession, sf_dir: str) -> Graph:
    """Suppliers that share an order, both directions; weight: shared orders."""
    lines = table(spark, sf_dir, "lineitem").where("l_orderkey is not null")
    orders = lines.groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("all")).where("size(all) > 1")
    # A pair travels in one direction and is turned round once it is counted.
    pairs = orders.select(F.explode("all").alias("a"), "all").select("a", F.explode("all").alias("b")).where("a < b")
    pairs = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    ways = F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))
    return Graph(pairs.select(F.explode(ways).alias("e"), "weight").select("e.src", "e.dst", "weight"))


def line_chains(spark: SparkSession, sf_dir: str) -> Graph:
    """A graph of many components: an order's lines (order * 8 + line), consecutive ones linked both ways."""
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), "l_orderkey", "l_linenumber").distinct()
    after = lines.select(F.col("id").alias("dst"), "l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"))
    one = lines.withColumnRenamed("id", "src").join(after, ["l_orderkey", "l_linenumber"]).select("src", "dst")
    return Graph(Graph(one).symmetrised().edges, lines.select("id"))


#: Data sets by name; ``register`` adds one.
DATASETS: dict[str, Callable[[SparkSession, str], Graph]] = {"supplier_parts": supplier_parts, "part_co_orders": part_co_orders, "supplier_co_orders": supplier_co_orders, "line_chains": line_chains}


def register(name: str) -> Callable:
    def add(f: Callable[[SparkSession, str], Graph]) -> Callable[[SparkSession, str], Graph]:
        DATASETS[name] = f
        return f

    return add


def load(name: str, spark: SparkSession, path: str, largest_component: bool = False) -> Graph:
    if name not in DATASETS:
        raise ValueError(f"no data set {name!r}; there are {', '.join(sorted(DATASETS))}")
    graph = DATASETS[name](spark, path)
    return graph.lcc() if largest_component else graph


#: Classification problems by name: ``(labels (id, y), split (id, part))`` of a data set.
PROBLEMS: dict[str, Callable[[SparkSession, str], tuple[DataFrame, DataFrame]]] = {}


def register_problem(name: str) -> Callable:
    def add(f: Callable) -> Callable:
        PROBLEMS[name] = f
        return f

    return add


def load_problem(name: str, spark: SparkSession, path: str, graph: Graph | None = None) -> tuple[DataFrame, DataFrame]:
    """Labels and split; with a relabelled graph those of its nodes, under its ids."""
    if name not in PROBLEMS:
        raise ValueError(f"no classification problem {name!r}; there are {', '.join(sorted(PROBLEMS))}")
    labels, split = PROBLEMS[name](spark, path)
    if graph is not None and "label" in graph.nodes.columns:
        new = graph.nodes.select(F.col("id").alias("new"), F.col("label").alias("id"))
        labels, split = (x.join(new, "id").select(F.col("new").alias("id"), c) for x, c in ((labels, "y"), (split, "part")))
    return labels, split


def _stored(name: str, own_split: bool) -> None:
    """A data set that ``save`` has put under ``path/name``, its split beside it if it has one of its own."""

    @register(name)
    def graph(spark: SparkSession, path: str) -> Graph:
        return open_folder(spark, f"{path}/{name}")

    @register_problem(name)
    def problem(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
        from tessera.operators.score import random_split

        labels = spark.read.parquet(f"{path}/{name}/nodes").select("id", F.when(F.isnan(F.col("y").cast("double")), -1).otherwise(F.coalesce("y", F.lit(-1))).cast("long").alias("y"))
        return labels, spark.read.parquet(f"{path}/{name}/split") if own_split else random_split(labels)


for _name in ("Cora", "CiteSeer", "PubMed"):
    _stored(_name, True)
for _name in ("AMZcomputers", "AMZphoto"):
    _stored(_name, False)


@register("MAG240M")
def _papers(spark: SparkSession, path: str, directed: bool = False, features: bool = True) -> Graph:
    """The citation graph from its folder of arrays; undirected: both directions of every edge, sorted and without repeats."""
    from tessera.sources.arrays import read_arrays

    graph = read_arrays(spark, f"{path}/MAG240M", features)
    return graph if directed else graph.symmetrised()


@register_problem("MAG240M")
def _paper_classes(spark: SparkSession, path: str, validation: int = 10_000, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Labels (-1 where there is none) and the split: of the stored part ``valid`` the first by hash validate, the others test."""
    from tessera.sources.arrays import read_arrays

    nodes = read_arrays(spark, f"{path}/MAG240M", features=False).nodes
    stored = spark.read.parquet(f"{path}/MAG240M/split")
    held = stored.where("part = 'valid'").withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))))
    val = held.orderBy("h", "id").limit(validation).select("id", F.lit("val").alias("part"))
    test = held.join(val.select("id"), "id", "left_anti").select("id", F.lit("test").alias("part"))
    return nodes.select("id", "y"), stored.where("part = 'train'").unionByName(val).unionByName(test)


def save(graph: Graph, folder: str, mode: str = "errorifexists") -> None:
    """Edges and nodes, with features and labels, as Parquet, the edges in order of their source; and one row of counts."""
    graph.edges.repartitionByRange("src").sortWithinPartitions("src", "dst").write.mode(mode).parquet(f"{folder}/edges")
    graph.nodes.write.mode(mode).parquet(f"{folder}/nodes")
    graph.metadata().withColumn("undirected", F.lit(graph.is_undirected().first()[0])).write.mode(mode).json(f"{folder}/info")


def open_folder(spark: SparkSession, folder: str) -> Graph:
    return Graph(spark.read.parquet(f"{folder}/edges"), spark.read.parquet(f"{folder}/nodes"))


# The flow data's days, those with known incidents, and its numbers of sources and destinations.
DAYS = [f"day-{d:02}" for d in range(2, 91)]
INCIDENT_DAYS = [d for d in range(49, 89) if d != 75]
FLOW_SOURCES, FLOW_DESTINATIONS = 37_177, 931_655
FLOW_SCHEMA = "source_id long, dest_id long, total_time double, src_packets long, dest_packets long, src_bytes long, dst_bytes long"


def read_flows(spark: SparkSession, folder: str, protocol: str = "tcp", days: list[str] | slice | None = None) -> DataFrame:
    """Daily flow files ``netflow_{day}_aggregate_{protocol}.csv``; with ``days``, names or a slice of ``DAYS``, only their
    files are read."""
    names = DAYS[days] if isinstance(days, slice) else days
    paths = [f"{folder}/netflow_{d}_aggregate_{protocol}.csv" for d in names] if names else f"{folder}/netflow_*_aggregate_{protocol}.csv"
    rows = spark.read.schema(FLOW_SCHEMA).csv(paths)
    return rows.withColumn("day", F.regexp_extract(F.input_file_name(), "netflow_(.*)_aggregate_", 1))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """``(name, id)`` of a JSON object that numbers names."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string, long>")).alias("name", "id"))


def read_compromised(spark: SparkSession, path: str, index: DataFrame | None = None) -> DataFrame:
    """Distinct ``name`` of compromised hosts in a CSV of (user, host); with ``index (name, id)`` their ids as well."""
    names = spark.read.schema("user string, name string").csv(path).where("name is not null").select("name").distinct()
    return names if index is None else names.join(index, "name").select("name", "id")


def adjacency(flows: DataFrame, weight: str | None = None, transform: Callable = lambda c: c) -> DataFrame:
    """``(day, src, dst, weight)``: 1 a row, or a transformed column, summed over repeated cells."""
    value = transform(F.col(weight).cast("double")) if weight else F.lit(1.0)
    return flows.groupBy("day", F.col("source_id").alias("src"), F.col("dest_id").alias("dst")).agg(F.sum(value).alias("weight"))
