"""Look-ups of words in a table of words."""

from pyspark.sql import DataFrame

from newsframe.session import materialise


def lookup_join(rows: DataFrame, table: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Joins word occurrences with a table that has one row per word (or per combination of ``on``).

    The table is computed once and stored, so Spark knows its bytes: below ``spark.sql.autoBroadcastJoinThreshold`` it is
    sent to the rows, which stay where they are; above, both sides are shuffled by word and AQE splits a word that
    fills more than its share of a partition.
    """
    return rows.join(materialise(table), [on] if isinstance(on, str) else on, how)
