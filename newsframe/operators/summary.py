"""Number summaries per class. The rows are read once; everything else works on the counts of distinct values."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsframe.operators.ordering import distinct_values, join_groups, quantiles_of


def _quartiles(values: DataFrame, by: list[str]) -> DataFrame:
    return (quantiles_of(values, by, [0.25, 0.5, 0.75]).groupBy(*by)
            .pivot("probability", [0.25, 0.5, 0.75]).agg(F.first("quantile"))
            .withColumnsRenamed({"0.25": "q1", "0.5": "median", "0.75": "q3"}))


def describe_by_class(df: DataFrame, value: str, flag: str) -> DataFrame:
    """count, mean, std, min, quartiles and max of a number for all rows, reliable rows and fake rows."""
    name = F.when(F.col(flag), "fake").when(~F.col(flag), "reliable")
    values = (distinct_values(df, [flag], value)
              .select("value", "size", F.explode(F.array(F.lit("total"), name)).alias("class"))
              .filter(F.col("class").isNotNull()).groupBy("class", "value").agg(F.sum("size").alias("size")))
    sums = values.groupBy("class").agg(
        F.sum("size").alias("count"), (F.sum(F.col("value") * F.col("size")) / F.sum("size")).alias("mean"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    off = F.col("value") - F.col("mean")
    std = values.join(sums, "class").groupBy("class", "count").agg(F.sum(off * off * F.col("size")).alias("_squares"))
    std = std.select("class", F.sqrt(F.try_divide("_squares", F.col("count") - 1)).alias("std"))
    return sums.join(std, "class").join(_quartiles(values, ["class"]), "class").select(
        "class", "count", "mean", "std", "min", "q1", "median", "q3", "max")


def box_stats(df: DataFrame, measures: dict[str, Column], by: list[str], with_outliers: bool = True) -> DataFrame:
    """Box-plot numbers of several measures per class in one job.

    ``measures`` maps names to columns. Whiskers are the outermost values within 1.5 interquartile ranges of the
    box; ``with_outliers`` adds the number of values beyond them.
    """
    cells = F.explode_outer(F.array(*[F.struct(F.lit(name).alias("measure"), column.cast("double").alias("value"))
                                      for name, column in measures.items()]))
    keys = ["measure", *by]
    values = distinct_values(df.select(*by, cells.alias("cell")).select(*by, "cell.*"), keys, "value")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    above = F.col("value") >= F.col("q1") - reach
    below = F.col("value") <= F.col("q3") + reach
    out = join_groups(values, _quartiles(values, keys), keys).groupBy(*keys, "q1", "median", "q3").agg(
        F.sum("size").alias("count"),
        F.min(F.when(above, F.col("value"))).alias("low"),
        F.max(F.when(below, F.col("value"))).alias("high"),
        F.sum(F.when(~(above & below), F.col("size")).otherwise(0)).alias("outliers"))
    # A whisker never ends inside the box.
    out = out.withColumns({"low": F.least(F.coalesce("low", "q1"), "q1"), "high": F.greatest(F.coalesce("high", "q3"), "q3")})
    return out if with_outliers else out.drop("outliers")
