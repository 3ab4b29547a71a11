"""Session helpers shared by every operator: table access, shared storage, partition counts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Bytes of stored input that one task of a Python kernel is given.
TASK_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, local mode gets a temporary folder; a cluster,
    whose executors wouldn't see it, raises."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master.split("[")[0] != "local":
            raise RuntimeError(f"spark.checkpoint.dir is unset on {master}: intermediate tables need a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='troupe-shared-')}"
        spark.conf.set("spark.checkpoint.dir", found)
        atexit.register(shutil.rmtree, found.removeprefix("file://"), ignore_errors=True)
    return found


_written: list[str] = []


def release(spark: SparkSession, since: int = 0) -> None:
    """Removes the intermediate tables written by this session from the `since`-th on. DataFrames that read them can't be run any more."""
    jvm = spark.sparkContext._jvm
    for name in _written[since:]:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    del _written[since:]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at its end the intermediate tables that are written within it, so that a long session doesn't fill the shared folder."""
    since = len(_written)
    try:
        yield
    finally:
        release(spark, since)


def _release_at_exit(spark: SparkSession) -> None:
    try:
        release(spark)
    except Exception:  # the JVM may be gone already
        pass


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df once as a table in the shared folder and reads it back, so that later stages neither
    recompute it nor depend on any one executor."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), "troupe", f"{label}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    if not _written:
        atexit.register(_release_at_exit, spark)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes the intermediate table that materialize() returned as df before the session ends. What reads it can't be run any more."""
    held = {os.path.basename(os.path.dirname(x)) for x in df.inputFiles()}
    jvm = df.sparkSession.sparkContext._jvm
    for name in [x for x in _written if os.path.basename(x) in held]:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of an action go as soon as it ends, and not when the driver happens to collect its garbage. For tables
    that are written and counts that are taken once; a DataFrame to be run again is to be made outside."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def input_bytes(df: DataFrame) -> int:
    """Stored bytes that df is made from: the planner's sizes of the leaves of its plan."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size()))
    return sum(x for x in sizes if x < 1 << 62)  # what the planner knows nothing about has the largest size there is


def width(df: DataFrame) -> int:
    """Number of partitions for an exchange of df's rows that feeds a Python kernel, whose cost is CPU and not bytes, so that adaptive
    coalescing by bytes would leave cores idle: at least two for each core, and more as the input grows."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism, -(-input_bytes(df) // TASK_BYTES))


#: Nodes of a plan that move no rows.
_STAYS = frozenset(("Project", "Filter", "Generate", "MapInArrow", "MapInPandas", "SubqueryAlias", "LocalLimit"))


def _moves(plan) -> bool:
    children = plan.children()
    if not children.size():
        return False
    return plan.nodeName() not in _STAYS or any(_moves(children.apply(k)) for k in range(children.size()))


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores: unchanged where its input is large or its scan is of as many files as there
    are cores, else dealt anew."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if input_bytes(df) >= cores * TASK_BYTES * 4:
        return df
    if not _moves(df._jdf.queryExecution().optimizedPlan()) and len(df.inputFiles()) >= cores:
        return df
    return df.repartition(2 * cores)
