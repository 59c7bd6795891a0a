"""Canonical schemas of articles and statements."""

from pyspark.sql import types as T

ARTICLE = T.StructType([T.StructField("id", T.LongType())] + [
    T.StructField(name, T.StringType()) for name in (
        "domain", "type", "url", "content", "scraped_at", "inserted_at", "updated_at", "title",
        "authors", "keywords", "meta_keywords", "meta_description", "tags", "summary")])

ARTICLE_KEPT = ["id", "domain", "type", "content", "title", "authors"]

STATEMENT = T.StructType([
    T.StructField(name, T.StringType()) for name in (
        "id", "label", "statement", "subjects", "speaker", "speaker_job", "state_info", "party")
] + [
    T.StructField(name, T.IntegerType()) for name in (
        "barely_true", "false", "half_true", "mostly_true", "pants_on_fire")
] + [T.StructField("context", T.StringType())])

SENTIMENT = T.StructType([T.StructField("polarity", T.DoubleType()),
                          T.StructField("subjectivity", T.DoubleType())])

# Split ids used in the `set` column.
TRAIN, VALIDATION, TEST = 0, 1, 2
