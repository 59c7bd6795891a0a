"""The query registry and the frames that most queries start from."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsframe.functions import text
from newsframe.operators.sampling import quota_split
from newsframe.session import spread

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Registers a function under its own name, with its SQL if there is one."""
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function
    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str, name: str = "documents") -> DataFrame:
    """A text table ready for cleaning."""
    return spread(table(spark, sf, name))


def flags(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, fake) of the labelled documents; fake = low quality or toxic."""
    return table(spark, sf, "labels").select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("fake"))


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a label; the others are dropped before the texts are spread."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "source", "lang")
    return spread(docs.join(flags(spark, sf), "doc_id"))


def labelled_words(spark: SparkSession, sf: str) -> DataFrame:
    return labelled(spark, sf).withColumn("words", text.tokens(text.clean_text(F.col("text"))))


def documents_in_sets(spark: SparkSession, sf: str) -> DataFrame:
    """All documents with set 0, 1 or 2 (60, 20 and 20 percent in key order)."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    return spread(quota_split(docs, docs.count(), [0.6, 0.2, 0.2], [False, False, False], "doc_id", "lang"))


def rounded(column, digits: int = 6):
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column, digits)
