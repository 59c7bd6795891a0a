"""Incremental runs: each call handles the files that arrived since the last one."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsframe.operators.sampling import continue_split, merge_summaries, sample_summary
from newsframe.operators.vocabulary import vocabulary
from newsframe.session import discard, materialise


def read_new_files(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                   files_per_batch: int | None = None, **options) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def run_steps(stream: DataFrame, steps: Callable, path: str, checkpoint: str) -> None:
    """Applies a step list to all new rows and appends them to a Parquet folder, each file exactly once."""
    (steps(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def add_word_counts(stream: DataFrame, words: str, path: str, checkpoint: str) -> None:
    """Adds the word counts of all new rows as one partial table per batch.

    A batch that is run again after a failure replaces its own table, so nothing is counted twice and no state has
    to be kept for the vocabulary.
    """
    def store(batch: DataFrame, number: int) -> None:
        vocabulary(batch, words).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    (stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def running_word_counts(spark: SparkSession, path: str) -> DataFrame:
    """(word, n) over all batches so far."""
    return spark.read.parquet(path).groupBy("word").agg(F.sum("n").alias("n"))


def add_samples(stream: DataFrame, group: str, keys: list[str], n: int, path: str, checkpoint: str, seed: int = 0) -> None:
    """Adds the sample summary of every batch; a batch that is run again replaces its own."""
    def store(batch: DataFrame, number: int) -> None:
        sample_summary(batch, group, keys, n, seed).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    (stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def running_sample(spark: SparkSession, path: str, group: str, keys: list[str], n: int) -> DataFrame:
    """The sample per group over all batches so far, as if they had come at once."""
    return merge_summaries([spark.read.parquet(path).drop("batch")], group, keys, n).drop("place")


def _split_state(spark: SparkSession, path: str, before: int | None = None) -> tuple[int, dict]:
    """The state that the last batch, or the last one before a number, has left."""
    schema = "at int, label string, n long, batch long"
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/state")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return 0, {}
    rows = spark.read.schema(schema).parquet(f"{path}/state")
    rows = rows if before is None else rows.filter(F.col("batch") < before)
    last = rows.agg(F.max("batch")).first()[0]
    left = rows.filter(F.col("batch") == last).collect() if last is not None else []  # a row per class
    return (left[0].at, {row.label: row.n for row in left if row.n is not None}) if left else (0, {})


def add_quota_split(stream: DataFrame, total_size: int, splits: list[float], balanced: list[bool], key: str, path: str, checkpoint: str,
                    label: str = "type", classes: list | None = None) -> None:
    """Gives all new rows their sets, as ``quota_split`` would in the order of the batches and of the keys inside each.

    ``label`` and ``classes`` are strings. Rows whose key has come before are ignored: Spark's keyed state holds the keys,
    which grows with the rows (use a state store on disk for long streams). Every batch leaves the number of the open set
    and the counts of its classes beside its rows; a batch that is run again starts from what the one before has left and
    replaces its own. Once all sets are full the stream is not read any more, nor are further batches split.
    """
    spark, path = stream.sparkSession, path.rstrip("/")
    if _split_state(spark, path)[0] >= len(splits):
        return

    def store(batch: DataFrame, number: int) -> None:
        state = _split_state(spark, path, number)
        rows = materialise(batch)  # read once, as the batch moves the state of the keys
        if state[0] < len(splits):
            found, state = continue_split(rows, total_size, splits, balanced, key, state, label, classes)
            found.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        counts = [(state[0], name, n) for name, n in state[1].items()] or [(state[0], None, None)]
        spark.createDataFrame(counts, "at int, label string, n long").coalesce(1).write.mode("overwrite").parquet(f"{path}/state/batch={number}")
        discard(rows)

    (stream.dropDuplicates([key]).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def running_split(spark: SparkSession, path: str) -> DataFrame:
    """The rows with their sets over all batches so far."""
    return spark.read.parquet(f"{path.rstrip('/')}/rows").drop("batch")
