"""Cutting lineage and iterating to a fixed point."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.  Where the session
    leaves it unset (a local session, as in tests) a temporary folder takes its place."""
    set_already = spark.conf.get("spark.checkpoint.dir", None)
    if set_already:
        return set_already
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        made = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(made)
    return context.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder; it survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as Parquet in the shared folder, and its path: compressed, and read by column."""
    path = f"{shared_dir(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def kept(df: DataFrame) -> DataFrame:
    return written(df)[0]


#: Rows of two numbers that are sent to every task rather than shuffled with a large table, at most.
MOST_SENT = 2_000_000


def sent(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df``, which is kept somewhere, for joins with a large table: sent to all tasks if it has few enough rows."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= MOST_SENT else df


def remove(spark: SparkSession, path: str) -> None:
    """Deletes what ``written`` has written, once nothing reads it any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def forget(df: DataFrame) -> None:
    """Deletes the checkpoint that ``cut`` made for ``df``, once no frame reads it any more."""
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        remove(df.sparkSession, file.get())


def release(spark: SparkSession) -> None:
    """Has the JVM collect: only then Spark deletes the shuffles and broadcasts that nothing refers to any more.  What the
    driver has freed goes back to the system."""
    gc.collect()
    spark._jvm.System.gc()
    trimmed(spark)


def trimmed(spark: SparkSession) -> str | None:
    """Has the JVM hand back memory beside its heap that it has freed, which compilers leave behind; says what came of it,
    or None where the JVM has no such command."""
    java, array = spark._jvm.java.lang, spark.sparkContext._gateway.new_array
    call = array(java.Object, 4)
    try:
        call[0], call[1] = spark._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        call[2], call[3] = array(java.Object, 0), array(java.String, 0)
        invoke = next(m for m in java.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        return invoke.invoke(java.management.ManagementFactory.getPlatformMBeanServer(), call)
    except Py4JError:
        return None


def fixpoint(state: DataFrame, step: Callable[[DataFrame], DataFrame], most: int = 200) -> DataFrame:
    """Applies ``step`` until the rows stop changing; each round is cut from its lineage."""

    def sign(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(struct(*)))"), F.expr("sum(cast(xxhash64(struct(*)) as decimal(38,0)))")).first())

    state = cut(state)
    seen = sign(state)
    for _ in range(most):
        before, state = state, cut(step(state))
        forget(before)
        release(state.sparkSession)
        now = sign(state)
        if now == seen:
            return state
        seen = now
    raise RuntimeError(f"no fixed point within {most} rounds")
