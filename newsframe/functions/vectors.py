"""Number arrays."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise(vector: Column) -> Column:
    """Vector over its signed sum; unchanged if the sum is zero."""
    total = F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return F.when(total == 0, vector.cast("array<double>")).otherwise(
        F.transform(vector, lambda x: x.cast("double") / total))


def vector_text(vector: Column) -> Column:
    """Numbers with blanks between them."""
    return F.array_join(vector.cast("array<string>"), " ")


def text_vector(text: Column, dtype: str = "int") -> Column:
    """Numbers written with blanks between them."""
    return F.array_remove(F.split(text, " +"), "").cast(f"array<{dtype}>")
