"""Row filters, projections and checks."""

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsframe.functions.labels import ARTICLE_TYPES
from newsframe.operators.ordering import first_rows
from newsframe.schema import ARTICLE_KEPT, TEST, TRAIN, VALIDATION


def keep_values(df: DataFrame, column: str, values: Iterable) -> DataFrame:
    """Rows whose value is in the list; missing values go."""
    return df.filter(F.col(column).isin(list(values)))


def usable_articles(df: DataFrame, content: str = "content", kind: str = "type", domain: str = "domain",
                    kinds: list[str] | None = None, error_prefix: str = "Error") -> DataFrame:
    """Rows with content that is not an error page, a known type and a domain."""
    return df.filter(F.col(content).isNotNull() & ~F.col(content).startswith(error_prefix)
                     & F.col(kind).isin(ARTICLE_TYPES if kinds is None else kinds) & F.col(domain).isNotNull())


def usable_columns(df: DataFrame) -> DataFrame:
    """The article columns that later steps read."""
    return df.select(*ARTICLE_KEPT)


def split_frames(df: DataFrame, features: str | list[str], flag: str, set_col: str = "set",
                 with_validation: bool = True) -> dict[str, DataFrame]:
    """One frame per set with the feature columns and the flag as 0/1 in ``label``."""
    columns = [features] if isinstance(features, str) else list(features)
    sets = {"train": TRAIN, "val": VALIDATION, "test": TEST}
    if not with_validation:
        del sets["val"]
    return {name: df.filter(F.col(set_col) == number).select(*columns, F.col(flag).cast("int").alias("label"))
            for name, number in sets.items()}


def missing_values(df: DataFrame, column: str, key: str) -> DataFrame:
    """Keys of the rows whose value is missing."""
    return df.filter(F.col(column).isNull()).select(key)


def preview(df: DataFrame, n: int, order: str | None = None) -> DataFrame:
    """The first n rows, in key order if a key is given; put before a step list it limits the work of all steps."""
    return df.limit(n) if order is None else first_rows(df, n, order)
