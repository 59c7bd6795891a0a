"""The corpus pipeline: documents through the stages, each written as Parquet and read again."""

from pyspark.sql import DataFrame, SparkSession

from newsframe.llm.common import free_name, table
from newsframe.llm.decontamination import drop_contaminated
from newsframe.llm.jaccard import drop_similar
from newsframe.llm.mixing import mix_sources
from newsframe.llm.passages import keep_quality
from newsframe.llm.sharding import shard_rows
from newsframe.session import materialise

#: The classifier and the similarity join have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject (score 0.7 or more)."""
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group linked by shingles of five words and a similarity of 0.8 or more."""
    return drop_similar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without, or with few, words of benchmark windows."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source at the same expected share of the text; a document may come several times or not at all."""
    return mix_sources(docs, copy=free_name(docs, "copy"), order_key=free_name(docs, "order_key")).select(docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and slot."""
    return shard_rows(docs, "doc_id", [1.0] * 16)


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination),
          ("mixing sources to target weights", mixing), ("sharding", sharding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over all documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
