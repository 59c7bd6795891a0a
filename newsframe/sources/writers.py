"""Writers. Each is one parallel write that replaces or extends its target."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsframe.operators import frequency
from newsframe.session import materialise


def write_csv(df: DataFrame, path: str, append: bool = False, rows_per_file: int = 100_000) -> None:
    """CSV files of at most ``rows_per_file`` rows: a file with line breaks in its cells is read by one task."""
    (df.write.mode("append" if append else "overwrite").option("header", True).option("maxRecordsPerFile", rows_per_file)
     .option("quote", '"').option("escape", '"').csv(path))


def write_parquet(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").parquet(path)


def write_split(df: DataFrame, path: str, index: str, rows_per_file: int = 10000, files_per_task: int = 64) -> None:
    """CSV files of a fixed number of rows in index order, in one folder; the last file may be shorter.

    A range shuffle keeps runs of ``files_per_task`` whole files together, and every task cuts its sorted rows into
    files. Files so start at multiples of ``rows_per_file`` of the dense index, and ``file_number`` tells their numbers.
    """
    run = F.floor(F.col(index) / (rows_per_file * files_per_task))
    (df.withColumn("_run", run).repartitionByRange("_run").sortWithinPartitions(index).drop("_run")
     .write.mode("overwrite").option("header", True).option("maxRecordsPerFile", rows_per_file)
     .option("quote", '"').option("escape", '"').csv(path))


def write_statistics(df: DataFrame, path: str, kind: str = "type", domain: str = "domain",
                     content: str = "content") -> None:
    """The four statistics tables of a corpus: shape, types, domains, content lengths.

    The corpus is read once; all tables come from the stored types, domains and lengths.
    """
    path, columns = path.rstrip("/"), len(df.columns)
    slim = materialise(df.select(F.col(kind).alias("kind"), F.col(domain).alias("domain"), F.length(content).alias("content_length")))
    write_csv(frequency.table_shape(slim, columns), f"{path}/rows_cols")
    write_csv(frequency.counts_with_none(slim, "kind", "types"), f"{path}/types")
    write_csv(frequency.counts_with_none(slim, "domain", "domains"), f"{path}/domain")
    write_csv(slim.select("content_length"), f"{path}/content_length")


def write_vectors(df: DataFrame, path: str, experiment: str, append: bool = False) -> None:
    """Feature vectors and labels of one experiment, one folder per experiment and set."""
    (df.withColumn("experiment", F.lit(experiment)).write.mode("append" if append else "overwrite")
     .partitionBy("experiment", "set").parquet(path))


def read_vectors(spark: SparkSession, path: str, experiment: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("experiment") == experiment).drop("experiment")
