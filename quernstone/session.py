"""Session helpers shared by every operator: table reading, lineage cutting, the session used by tests and bench."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """The session of tests and bench; a cluster brings its own."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quernstone")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the cluster's ``spark.checkpoint.dir``, or one of our own only where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = named.get() if named.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="quernstone-checkpoint-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; survives the loss of any executor."""
    spark = df.sparkSession
    named = shared_dir(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again: cuts lineage, is columnar, and lets later
    stages read only the columns they need."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quernstone-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


_written: list[str] = []


def keep_until_dropped(path: str) -> None:
    """Has a folder that a query has written deleted with the others."""
    _written.append(path)


def drop_written(spark: SparkSession) -> int:
    """Deletes what :func:`written` has put into the shared folder; call it once results are saved. Returns how many."""
    n = 0
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        n += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def spread(df: DataFrame, most: int = 64) -> DataFrame:
    """``df`` over as many partitions as there are cores, for stages that compute much per row, where it comes in fewer, and
    in at most ``most``: about 8 GB at the usual size of a split. A larger input is never shuffled for this; where it has
    fewer splits than the cluster has cores, ``spark.sql.files.maxPartitionBytes`` makes more of them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    n = df.rdd.getNumPartitions()
    return df.repartition(cores) if n < cores and n <= most else df
