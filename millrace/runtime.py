"""Session defaults and lineage cutting.

Everything that has to survive the loss of an executor is written to the folder
named by ``spark.checkpoint.dir`` (shared storage on a cluster).  A folder of
our own is made only where a local session names none, as in tests; it goes with
the process.  ``release`` deletes what was written on a cluster.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIR: list[str] = []
_WRITTEN: list[str] = []


def session(name: str = "millrace", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators expect (AQE, Arrow, UTC)."""
    b = (
        SparkSession.builder.appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only if none is named and all executors are in this process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL_DIR:
        made = tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, made, True)
        _LOCAL_DIR.append("file://" + made)
    return _LOCAL_DIR[0]


def release(spark: SparkSession) -> None:
    """Delete all that this process has materialized. Frames that were read from it can't be used any more."""
    jvm = spark._jvm
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives executor loss."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """Spread a scan of few splits over the cores before per-row work that costs CPU.

    Only a scan that leaves more than half of the cores idle is spread, so at scale nothing is shuffled. A plan with a shuffle of its own (an adaptive one) is left alone too; asking it would run it.
    """
    want = least or df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution()
    if plan.executedPlan().nodeName().startswith("AdaptiveSparkPlan"):
        return df
    return df.repartition(want) if 2 * plan.toRdd().getNumPartitions() < want else df
