"""Mixing sources to target weights by Poisson replication."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsframe.llm.common import fraction, free_name, text_or_empty
from newsframe.session import materialise

STEP = 8.0  # largest mean that is inverted at once
TERMS = 64  # P(Poisson(8) > 64) is below 1e-30, beyond what a 52-bit uniform can reach


def repetition_rates(df: DataFrame, weights: dict[str, float] | None = None, default: float = 1.0,
                     total: float | None = None, source: str = "source", text: str = "text") -> DataFrame:
    """(source, size, rate): how often each document of a source is repeated on average.

    A source's size is its number of code points. The sources that are present share ``total`` (default: the size of
    all) in proportion to their weights; a source that ``weights`` does not list has ``default``. Null is a source.
    A source without any text, or without weight, has rate 0.
    """
    weight = F.lit(float(default))
    for name, value in (weights or {}).items():
        weight = F.when(F.col(source) == name, F.lit(float(value))).otherwise(weight)
    sizes = df.groupBy(source).agg(F.sum(F.char_length(text_or_empty(text))).alias("size")).withColumn("weight", weight)
    whole = sizes.filter("size > 0").agg(F.sum("size").alias("all"), F.sum("weight").alias("weights"))
    goal = F.col("all").cast("double") if total is None else F.lit(float(total))
    rate = F.when((F.col("size") > 0) & (F.col("weight") > 0), goal * F.col("weight") / F.col("weights") / F.col("size"))
    return sizes.crossJoin(F.broadcast(whole)).select(source, "size", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def poisson_table(mean: Column) -> Column:
    """Array of P(X <= k) for k = 0 .. 64, for a mean of at most 8."""
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("sums"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS)), start,
        lambda acc, k: F.struct((acc["p"] * mean / k).alias("p"),
                                F.concat(acc["sums"], F.array(F.element_at(acc["sums"], -1) + acc["p"] * mean / k))
                                .alias("sums")),
        lambda acc: acc["sums"])


def mix_sources(df: DataFrame, weights: dict[str, float] | None = None, key: str = "doc_id", source: str = "source",
                text: str = "text", seed: int = 0, default: float = 1.0, total: float | None = None, copy: str = "copy",
                order_key: str = "order_key") -> DataFrame:
    """Every document as often as its hash-seeded Poisson number says, all copies in one global random order.

    Adds ``copy`` (from 1) and ``order_key`` (md5; the random order), or columns of other names; columns that have these
    names already are replaced, all others stay. The number of a document depends on seed, key
    and its source's rate alone: a uniform from the md5 of the key is inverted in the table of the source's
    distribution. A mean above 8 is a sum of equal parts with a uniform each, so a tiny source that is repeated
    thousands of times needs no long table. Counts are combined before the shuffle, and a hot source is spread
    like any other, as the rates are joined to the documents and not the reverse.

    Rows with null or repeated keys draw the same number; null and empty texts count zero code points and are
    repeated like the rest of their source; an empty table stays empty.
    """
    # Stored, so that Spark knows that a few rates are small enough to go to the documents, and shuffles no text for them.
    rates = (materialise(repetition_rates(df, weights, default, total, source, text))
             .withColumn("parts", F.greatest(F.ceil(F.col("rate") / STEP), F.lit(1)).cast("int"))
             .withColumn("sums", poisson_table(F.col("rate") / F.col("parts"))))
    name, draw = free_name(df, "source"), free_name(df, "draw")
    rates = rates.select(F.col(source).alias(name), F.struct("parts", "sums").alias(draw))
    parts, sums = F.col(draw)["parts"], F.col(draw)["sums"]
    number = F.aggregate(
        F.sequence(F.lit(1), parts), F.lit(0),
        lambda total, part: total + F.size(F.filter(sums, lambda bound: bound < fraction(F.lit(seed), part, F.col(key)))))
    own = [column for column in df.columns if column not in (copy, order_key)]
    copies = (df.join(rates, F.col(source).eqNullSafe(F.col(name))).select(*own, number.alias(draw)).filter(F.col(draw) > 0)
              .select(*own, F.explode(F.sequence(F.lit(1), F.col(draw))).alias(copy)))
    text_key = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    ordered = copies.withColumn(order_key, F.md5(F.concat_ws(":", F.lit(f"order {seed}"), text_key, F.col(copy))))
    # The partition and the place in it both come from the md5, so the whole sequence is a random order; unlike a
    # range sort this does not run the upstream a second time for its sample.
    return ordered.repartition(order_key).sortWithinPartitions(order_key, key)
