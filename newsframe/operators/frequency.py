"""Value and word frequencies, overall and per class.

Counts are combined before they are shuffled, so a value that fills a third of all rows costs one row per task.
Shares divide by a scalar subquery or by a per-class total, never by a window over all values. Ranks come from
``row_number() <= n``, which Spark cuts to n rows per class and task before the shuffle.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsframe.functions.text import none_if_missing
from newsframe.operators.ordering import range_index

SMALL_TOP = 1000  # the largest n that is taken as a heap of n rows per task


def value_counts(df: DataFrame, column: str, name: str = "value", split: str | None = None) -> DataFrame:
    """(value, n); ``split`` cuts delimited text into single values first."""
    value = F.col(column) if split is None else F.explode_outer(F.split(column, split))
    return df.select(value.alias(name)).groupBy(name).agg(F.count("*").alias("n"))


def occurrences(df: DataFrame, words: str | Column, *columns: str | Column, name: str = "word") -> DataFrame:
    """(columns..., word): one row per word.

    A plain explode would make Spark filter on the size of the list first, which computes a cleaned and tokenised
    list several times; the outer form does not.
    """
    return df.select(*columns, F.explode_outer(words).alias(name)).filter(F.col(name).isNotNull())


def word_counts(df: DataFrame, words: str, by: list[str] | None = None) -> DataFrame:
    """(by..., word, n) over all words of all rows; an empty or missing list counts as one missing word."""
    by = by or []
    return (df.select(*by, F.explode_outer(words).alias("word")).groupBy(*by, "word")
            .agg(F.count("*").alias("n")))


def with_share(counts: DataFrame, by: list[str] | None = None, name: str = "percentage",
               scale: float = 100.0) -> DataFrame:
    """Adds n as a share of all n, or of all n in its class."""
    if not by:
        total = counts.agg(F.sum("n").alias("total"))
        return counts.withColumn(name, F.lit(scale) * F.col("n") / total.scalar())
    totals = counts.groupBy(*by).agg(F.sum("n").alias("_total"))
    return counts.join(totals, by).withColumn(name, F.lit(scale) * F.col("n") / F.col("_total")).drop("_total")


def top(counts: DataFrame, n: int | None, value: str, by: list[str] | None = None, rank: str | None = None) -> DataFrame:
    """The n most frequent values (per class), ties in the order of the value."""
    order = [F.desc("n"), F.asc_nulls_last(value)]
    if by:
        ranked = counts.withColumn(rank or "rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
        ranked = ranked if n is None else ranked.filter(F.col(rank or "rank") <= n)
        return ranked if rank else ranked.drop("rank")
    if n is None and rank is None:
        return counts.orderBy(*order)
    if n is None or n > SMALL_TOP:  # n rows of every task would meet in one: all rows are numbered in their ranges
        numbered = range_index(counts, order, "_place")
        numbered = numbered if n is None else numbered.filter(F.col("_place") < n)
        return numbered.drop("_place") if rank is None else numbered.withColumn(rank, F.col("_place") + 1).drop("_place")
    best = counts.orderBy(*order).limit(n)
    # The limit bounds the rows that are numbered in one task.
    return best if rank is None else best.withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def value_frequency(df: DataFrame, column: str, percentage: bool = True, n: int | None = None,
                    split: str | None = None) -> DataFrame:
    """Distribution of a column (types, flags, domains, subjects), most frequent first."""
    counts = value_counts(df, column, split=split)
    return top(with_share(counts) if percentage else counts, n, "value")


def word_frequency_by_class(df: DataFrame, words: str, by: str, n: int = 25) -> DataFrame:
    """The n most frequent words of each class with their share of all words of the class."""
    counts = word_counts(df.filter(F.col(by).isNotNull()), words, [by])
    totals = counts.groupBy(by).agg(F.sum("n").alias("_total"))
    return (top(counts, n, "word", [by], "rank").join(totals, by)
            .withColumn("percentage", 100.0 * F.col("n") / F.col("_total")).drop("_total"))


def value_frequency_by_class(df: DataFrame, column: str, by: str, n: int = 25, fill_none: bool = False) -> DataFrame:
    """The n most frequent values (parties, speakers) of each class with their share of the rows of the class."""
    value = none_if_missing(F.col(column)) if fill_none else F.col(column)
    counts = (df.filter(F.col(by).isNotNull()).select(by, value.alias("value")).groupBy(by, "value")
              .agg(F.count("*").alias("n")))
    totals = counts.groupBy(by).agg(F.sum("n").alias("_total"))
    return (top(counts, n, "value", [by], "rank").join(totals, by)
            .withColumn("percentage", 100.0 * F.col("n") / F.col("_total")).drop("_total"))


def shared_top_words(df: DataFrame, words: str, flag: str, n: int = 40) -> DataFrame:
    """Top-n words of reliable and fake rows, each in the region ``reliable``, ``fake`` or ``both``."""
    counts = word_counts(df.filter(F.col(flag).isNotNull()), words, [flag])
    best = top(counts, n, "word", [flag], "rank")
    region = (F.when(F.count("*") == 2, "both").when(F.bool_and(F.col(flag)), "fake").otherwise("reliable"))
    return best.groupBy("word").agg(region.alias("region"))


def table_shape(df: DataFrame, columns: int | None = None) -> DataFrame:
    """Number of rows and of columns (of ``df``, unless told)."""
    rows = df.agg(F.count("*").alias("rows"))
    columns = len(df.columns) if columns is None else columns
    return rows.select(F.explode(F.array(
        F.struct(F.lit("Number of rows").alias("statistic"), F.col("rows").alias("count")),
        F.struct(F.lit("Number of cols").alias("statistic"), F.lit(columns).cast("long").alias("count"))))
        .alias("row")).select("row.*")


def counts_with_none(df: DataFrame, column: str, name: str) -> DataFrame:
    """(value, count) with missing values as ``none``, most frequent first."""
    return (df.groupBy(none_if_missing(F.col(column)).alias(name)).agg(F.count("*").alias("count"))
            .orderBy(F.desc("count"), name))


def contribution(df: DataFrame, domain: str, kind: str, content: str, threshold: float = 0.0,
                 percentage: bool = True) -> DataFrame:
    """(domain, type, n[, percentage]): share of each domain in the rows of a type, cells from the threshold up."""
    cells = (df.filter(F.col(domain).isNotNull() & F.col(kind).isNotNull())
             .groupBy(domain, kind).agg(F.count(content).alias("n")))
    if not percentage:
        return cells.filter(F.col("n") >= threshold)
    return with_share(cells, [kind]).filter(F.col("percentage") >= threshold)


def contribution_table(df: DataFrame, domain: str, kind: str, content: str, kinds: list[str],
                       threshold: float = 0.0, percentage: bool = True) -> DataFrame:
    """The same cells with one column per type, ordered by the last type downwards, empty cells first."""
    cells = contribution(df, domain, kind, content, threshold, percentage)
    measure = "percentage" if percentage else "n"
    table = cells.groupBy(domain).pivot(kind, kinds).agg(F.first(measure))
    orders = [F.desc_nulls_first(name) for name in reversed(kinds)]
    return table.orderBy(*orders, domain)
