"""Helpers that several operators share."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else; pure ASCII text takes the JVM's fast path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fraction(*parts: Column) -> Column:
    """Uniform number in (0, 1) from 52 bits of the md5 of the parts; nulls count as the text 'null'."""
    text = F.concat_ws(":", *[F.coalesce(part.cast("string"), F.lit("null")) for part in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def bounded_sample(df: DataFrame, key: Column, rows: int, seed: int = 0) -> DataFrame:
    """At most ``rows`` rows, those with the least hash of the key.

    The hash first thins the table to about twice the rows, wherever they are, so that no task sends ``rows`` rows of
    its own to be merged.
    """
    place = fraction(F.lit(seed), key)
    share = min(1.0, 2.0 * rows / max(df.count(), 1))
    return df.filter(place <= share).orderBy(place, key).limit(rows)


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have, in any case of letters."""
    taken = {column.lower() for column in df.columns}
    found = f"__{name}"
    while found.lower() in taken:
        found += "_"
    return found
