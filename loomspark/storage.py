"""Written intermediate tables in the folder that driver and executors share.

The folder is ``spark.checkpoint.dir``. Only where a session with a local master leaves it unset
(tests, a single machine) a local one is set; a cluster without it is refused. A table written here
survives the loss of executors and cuts lineage. All tables of an application lie in one folder,
which ``release`` deletes once their results are read.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_FALLBACK = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; sets a local one if a local session has none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        os.makedirs(LOCAL_FALLBACK, exist_ok=True)
        found = tempfile.mkdtemp(prefix="loomspark-", dir=LOCAL_FALLBACK)
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/loomspark/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark's setting that removes an execution's shuffle files when it ends.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here.

    The shuffle files of the write go with it. Spark else keeps them until the driver collects its garbage, so that
    those of all steps of a job add up on the executors' disks.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(SWEEP, None)
    spark.conf.set(SWEEP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(SWEEP) if before is None else spark.conf.set(SWEEP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that written() returned; what was written from it since stays."""
    spark = df.sparkSession
    own = f"{_own_dir(spark)}/".split("://")[-1]
    for folder in {x.rpartition("/")[0] for x in df.inputFiles()}:
        if own in folder:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete every table that written() made in this application; DataFrames that read them are void."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of one Arrow batch sent to Python: with long texts the default of 10,000 takes hundreds of MB.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to BATCH_ROWS, unless it is lower already."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


#: Tasks of each core among which the rows of slow per-row work are dealt.
TASKS_A_CORE = 4


def dealt_out(df: DataFrame, *by: str) -> DataFrame:
    """df's rows dealt over all cores, by these columns if any, for slow per-row work after it.

    A table of short rows is a few files, often of one row group each, that few tasks read, and joins of such
    rows are coalesced to few: what is made of them would leave the other cores idle. A number that is given is not coalesced.
    """
    spark = df.sparkSession
    return df.repartition(max(TASKS_A_CORE * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)
