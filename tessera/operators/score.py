"""Link scores, ROC-AUC, splits, accuracy and result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.columns import distance, dot


def pair_scores(pairs: DataFrame, coords: DataFrame, by_distance: bool = False) -> DataFrame:
    """``pairs (src, dst, ...)`` with ``score``: sigmoid of the product, or exp(-distance), of ``coords (id, coord)``."""
    a, b = coords.select(F.col("id").alias("src"), F.col("coord").alias("_a")), coords.select(F.col("id").alias("dst"), F.col("coord").alias("_b"))
    score = F.exp(-distance("_a", "_b")) if by_distance else 1 / (1 + F.exp(-dot("_a", "_b")))
    return pairs.join(a, "src").join(b, "dst").withColumn("score", score).drop("_a", "_b")


def roc_auc(rows: DataFrame) -> DataFrame:
    """One row ``auc`` of ``rows (label, score)``, ties counting half.

    Equal scores are counted first; ranks then come from running sums over ranges of scores, so no task
    orders all rows.
    """
    from tessera.plans.iterate import cut

    per = rows.groupBy("score").agg(F.sum(F.col("label").cast("long")).alias("p"), F.sum(1 - F.col("label").cast("long")).alias("n"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(per.repartitionByRange(n, "score").withColumn("part", F.spark_partition_id()))
    sums = ranged.groupBy("part").agg(F.sum("n").alias("pn"))
    before = sums.select("part", F.coalesce(F.sum("pn").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inner = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = ranged.withColumn("inner", inner).join(F.broadcast(before), "part")
    wins = F.sum(F.col("p") * (F.col("before") + F.col("inner") + F.col("n") / 2))
    return below.agg((wins / (F.sum("p") * F.sum("n"))).alias("auc"))


def reconstruction_auc(graph, coords: DataFrame, by_distance: bool = False, most: int = 1_000_000, seed: int = 0) -> DataFrame:
    """One row ``auc``: how well ``coords (id, coord)`` tell the graph's edges from as many pairs that are none.  Of more than
    ``most`` edges that many are drawn, with replacement."""
    from tessera.plans.iterate import cut

    n = graph.edges.count()
    positive = graph.edges.select("src", "dst") if n <= most else graph.sample_positive(most, seed)
    negative = graph.sample_negative(min(n, most), seed)
    pairs = positive.withColumn("label", F.lit(1)).unionByName(negative.withColumn("label", F.lit(0)))
    return roc_auc(cut(pair_scores(pairs, coords, by_distance)).select("label", "score"))


def _draw(seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")))


def random_split(labels: DataFrame, train_per_class: int = 20, validation: int = 500, seed: int = 0) -> DataFrame:
    """``(id, part)`` of labelled nodes ``(id, y)``: the first of each class by hash train, the next validate,
    the others test.  Nodes without a label (null or negative) have no part.

    Spark keeps the first few of each class in a task before it shuffles them, and takes the first of the rest
    as a top-k, so no task sorts a whole class.
    """
    rows = labels.where("y >= 0").select("id", "y", _draw(seed).alias("h"))
    train = rows.withColumn("k", F.row_number().over(Window.partitionBy("y").orderBy("h", "id"))).where(F.col("k") <= train_per_class).select("id", F.lit("train").alias("part"))
    rest = rows.join(train.select("id"), "id", "left_anti")
    val = rest.orderBy("h", "id").limit(validation).select("id", F.lit("val").alias("part"))
    test = rest.join(val.select("id"), "id", "left_anti").select("id", F.lit("test").alias("part"))
    return train.unionByName(val).unionByName(test)


def views(labels: DataFrame, split: DataFrame) -> dict[str, DataFrame]:
    """Rows of ``labels (id, y)`` by view: ``train``, ``val`` and ``test`` by ``split (id, part)``, ``labelled`` (y of 0 or
    more) and ``all``."""
    parts = {p: labels.join(split.where(F.col("part") == p).select("id"), "id", "left_semi") for p in ("train", "val", "test")}
    return parts | {"labelled": labels.where("y >= 0"), "all": labels}


def accuracy(predicted: DataFrame, by: str | None = None) -> DataFrame:
    """Share of rows ``(y, predicted)`` that are equal, for labelled rows; by a column, if given."""
    rows = predicted.where("y >= 0")
    hit = F.avg((F.col("y") == F.col("predicted")).cast("double")).alias("accuracy")
    return rows.groupBy(by).agg(hit) if by else rows.agg(hit)


def entropy(rows: DataFrame, probabilities: str = "p") -> DataFrame:
    """One row: the mean entropy of an array column of probabilities."""
    h = F.aggregate(F.transform(probabilities, lambda p: F.when(p > 0, -p * F.log(p)).otherwise(F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    return rows.agg(F.avg(h).alias("entropy"))


def mean_and_deviation(results: DataFrame) -> DataFrame:
    """``(dim, key, mean, deviation)`` over the runs of ``results (dim, run, key, value)``; the sample deviation."""
    return results.groupBy("dim", "key").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("deviation"))


def best(results: DataFrame, dims: DataFrame, key: str) -> DataFrame:
    """``(dim, best)`` of ``dims``; minus infinity where a dimension has no value."""
    top = results.where(F.col("key") == key).groupBy("dim").agg(F.max("value").alias("best"))
    return dims.join(top, "dim", "left").select("dim", F.coalesce("best", F.lit(float("-inf"))).alias("best"))


def worst(results: DataFrame, dims: DataFrame, key: str) -> DataFrame:
    """``(dim, worst)`` of ``dims``; infinity where a dimension has no value."""
    low = results.where(F.col("key") == key).groupBy("dim").agg(F.min("value").alias("worst"))
    return dims.join(low, "dim", "left").select("dim", F.coalesce("worst", F.lit(float("inf"))).alias("worst"))


def values_of(results: DataFrame, dim: int, key: str) -> DataFrame:
    """``(run, value)`` of one dimension and key."""
    return results.where((F.col("dim") == dim) & (F.col("key") == key)).select("run", "value")


def runs(results: DataFrame, dims: DataFrame) -> DataFrame:
    """``(dim, runs)`` of ``dims``: how many runs there are, 0 where there is none."""
    per = results.groupBy("dim").agg(F.countDistinct("run").alias("runs"))
    return dims.join(per, "dim", "left").select("dim", F.coalesce("runs", F.lit(0).cast("long")).alias("runs"))


def has_dim(results: DataFrame, dims: DataFrame) -> DataFrame:
    """``(dim, found)`` of ``dims``."""
    return runs(results, dims).select("dim", (F.col("runs") > 0).alias("found"))


def without_dim(results: DataFrame, dim: int) -> DataFrame:
    return results.where(F.col("dim") != dim)


def only_dims(results: DataFrame, dims: DataFrame) -> DataFrame:
    """The rows of the dimensions in ``dims``."""
    return results.join(dims.select("dim").distinct(), "dim", "left_semi").select(*results.columns)


def append_run(results: DataFrame, new: DataFrame) -> DataFrame:
    """``results`` with the rows of ``new (dim, key, value)`` as each dimension's next run."""
    last = results.groupBy("dim").agg((F.max("run") + 1).alias("run"))
    rows = new.join(last, "dim", "left").select("dim", F.coalesce("run", F.lit(0)).cast(results.schema["run"].dataType).alias("run"), "key", "value")
    return results.select("dim", "run", "key", "value").unionByName(rows)


def flattened(rows: DataFrame, col: str, out: str = "value") -> DataFrame:
    """A row for each number in ``col``, an array nested to any depth."""
    from pyspark.sql.types import ArrayType

    kind = rows.schema[col].dataType
    value = F.col(col)
    while isinstance(kind, ArrayType) and isinstance(kind.elementType, ArrayType):
        value, kind = F.flatten(value), kind.elementType
    return rows.select(F.explode(value).alias(out))


def replace_runs(results: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by (dim, run, key)."""
    return results.join(new.select("dim", "run", "key"), ["dim", "run", "key"], "left_anti").unionByName(new)
