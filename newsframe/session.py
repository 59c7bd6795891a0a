"""Session helpers: a local session for tests and a shared folder for intermediate tables."""

import atexit
import gc
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(name: str = "newsframe", cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    return (SparkSession.builder.master(f"local[{cores}]").appName(name)
            .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.ui.enabled", "false")
            .config("spark.driver.memory", "16g")
            .getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """Folder of ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Where neither is set, a local master gets a temporary folder, which goes when Python ends; on a cluster that would
    not be shared.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="newsframe-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    context.setCheckpointDir(own)
    return context.getCheckpointDir()


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Queries that run inside remove their shuffle files at their end; else those stay until the driver collects garbage."""
    before = spark.conf.get(CLEANUP, None)
    if before is not None:
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is not None:
            spark.conf.set(CLEANUP, before)


def free_shuffles(spark: SparkSession) -> None:
    """Lets the driver drop what finished queries left: their shuffle files go when their plans are collected as garbage.

    Spark does this by itself every half hour (``spark.cleaner.periodicGC.interval``), which is too late for a job of
    many large steps. Call it between such steps.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def materialise(df: DataFrame, schema: StructType | None = None) -> DataFrame:
    """The frame written once as Parquet in the shared folder and read back.

    Cuts the lineage in a way that survives lost executors, and gives Catalyst the real size of the table, so that
    a later join broadcasts it only below ``spark.sql.autoBroadcastJoinThreshold``. ``schema`` may read the columns under
    other types that are stored alike.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{uuid.uuid4().hex}"
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    stored = df.sparkSession.read.schema(schema or df.schema).parquet(path)
    stored._stored_at = path
    return stored


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that no later step reads, so that a long job needs the room of its live tables alone.

    Call it only after everything that is made of them has been written itself: nothing can be computed again from
    them. Frames that ``materialise`` did not return are left alone.
    """
    for table in tables:
        path = getattr(table, "_stored_at", None) if isinstance(table, DataFrame) else None
        if path:
            place = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def spread(df: DataFrame, shuffled: bool = False) -> DataFrame:
    """Rows over all cores before costly expressions, if the scan has fewer tasks than there are cores.

    A large input already has more scan tasks than cores and is left as it is. ``shuffled`` asks for as many tasks as there
    are shuffle partitions, for steps whose memory grows with the rows of a task, as that of a scan task does with its file.
    """
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) if shuffled else 0)
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df
