"""Step lists: an ordered list of column and table functions folded into one lazy plan.

Entries are tuples:

``(f, column)``            rewrites a column with ``f(Column)``
``(f, source, target)``    derives a column with ``f(Column)``
``(f, None)``              maps the table with ``f(DataFrame)``
``(f, None, target)``      derives a column from the row with ``f(col)``, where ``col(name)`` gives a column
``(keep(p), column)``      drops the rows for which the predicate ``p(Column)`` is not true

``f`` may wrap pandas UDFs; anything that takes and returns a Column will do.
"""

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsframe.operators.rows import preview


@dataclass(frozen=True)
class keep:  # noqa: N801 - reads like a function in step lists
    """Marks a predicate; rows where it is false or unknown are dropped."""
    predicate: Callable


class Steps:
    """A callable for ``df.transform``; the input frame is never changed."""

    def __init__(self, steps: Sequence[tuple]):
        self.steps = [tuple(step) for step in steps]
        for step in self.steps:
            if len(step) not in (2, 3) or not (callable(step[0]) or isinstance(step[0], keep)):
                raise ValueError(f"not a step: {step!r}")

    def __call__(self, df: DataFrame) -> DataFrame:
        for function, source, *target in self.steps:
            if isinstance(function, keep):
                df = df.filter(function.predicate(F.col(source)))
            elif source is not None:
                df = df.withColumn(target[0] if target else source, function(F.col(source)))
            elif target:
                df = df.withColumn(target[0], function(F.col))
            else:
                df = function(df)
        return df

    def __add__(self, other: "Steps") -> "Steps":
        return Steps(self.steps + other.steps)


def run_files(spark, read: Callable, steps: Sequence[tuple] | None, write: Callable | None = None,
              total_rows: int | None = None, order: str | None = None) -> DataFrame:
    """Reads, limits, transforms and writes; without steps the (limited) input comes back as it is."""
    df = read(spark)
    if total_rows is not None:
        df = preview(df, total_rows, order)
    if steps is None:
        return df
    out = Steps(steps)(df)
    if write is not None:
        write(out)
    return out
