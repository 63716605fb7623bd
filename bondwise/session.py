"""Session defaults and lineage cutting through tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIRS: dict[str, str] = {}


def local_session(cores: int = 8, shuffle_partitions: int | None = None) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("bondwise")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder for tables that cut lineage.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master may fall back to a temporary folder,
    because a machine-local path is not visible to other executors.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="spark-bondwise-")
    return _LOCAL_DIRS[app]


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/bondwise/{tag}-{uuid.uuid4().hex}"


def cut(df: DataFrame, tag: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once and read it back: later rounds start from files that outlive any executor."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.cut_path = path
    return back


def forget(df: DataFrame | None) -> None:
    """Delete the table behind a DataFrame that ``cut`` returned, once nothing reads it any more."""
    path = getattr(df, "cut_path", None)
    if path:
        spark = df.sparkSession
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let shuffle files of finished jobs go: Spark deletes them once the driver's garbage collector finds their plans, which a roomy driver may put off for long."""
    spark.sparkContext._jvm.System.gc()


def cut_measured(df: DataFrame, tag: str, partition_by: str | None = None, **metrics) -> tuple[DataFrame, dict]:
    """``cut`` plus aggregates taken during the same write, so that a loop needs no second pass to decide."""
    seen = Observation()
    named = [expr.alias(name) for name, expr in metrics.items()]
    back = cut(df.observe(seen, F.count(F.lit(1)).alias("n_rows"), *named), tag, partition_by)
    return back, seen.get
