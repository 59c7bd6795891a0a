"""Sharding by rendezvous hashing of a stable key over weighted shards."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsframe.llm.common import fraction, free_name
from newsframe.session import materialise

ROWS_PER_BUCKET = 100_000


def _digest(key: str, *parts) -> Column:
    text = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    return F.md5(F.concat_ws(":", *[F.lit(str(part)) for part in parts], text))


def rendezvous(key: str, weights: list[float], seed: int = 0) -> Column:
    """The shard (0, 1, ...) with the highest score for the key.

    The score of a shard depends on key, shard and weight alone, so a further shard takes rows only into itself, and
    a removed one gives up only its own. A shard of weight w gets w / sum(weights) of the keys on average; weight 0
    gets none. With equal weights the md5 itself is the score.
    """
    if not any(weight > 0 for weight in weights) or any(weight < 0 for weight in weights):
        raise ValueError("weights must be non-negative and not all zero")
    live = [(number, weight) for number, weight in enumerate(weights) if weight > 0]
    if len({weight for _, weight in live}) == 1:
        scores = [(_digest(key, seed, number), number) for number, _ in live]
    else:
        scores = [(-F.lit(float(weight)) / F.log(fraction(F.lit(seed), F.lit(number), F.col(key))), number)
                  for number, weight in live]
    return F.array_max(F.array(*[F.struct(score.alias("score"), F.lit(number).alias("shard"))
                                 for score, number in scores]))["shard"]


def shard_rows(df: DataFrame, key: str, weights: list[float], seed: int = 0,
               grown_weights: list[float] | None = None, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Adds ``shard`` and ``slot`` (gapless from 0 in each shard), and ``grown_shard`` for ``grown_weights``.

    Slots follow the md5 of the key, then the key. No shard is sorted in one task: the md5 range is cut into as
    many buckets as the row count asks for, every (shard, bucket) numbers its own rows, and a table of bucket sizes
    shifts them. Rows of one key share a bucket. Where one key has more than ``rows_per_bucket`` rows in a bucket of more
    than twice as many, its rows are stored with a salt and numbered salt by salt, so a key with a third of all rows takes
    as many tasks as it needs. Null keys are one key like any other; rows of one key get their slots in any order; an empty
    table gives an empty one. Columns that the result names are replaced, all others stay.
    """
    buckets = max(1, -(-df.count() // (rows_per_bucket * len(weights))))
    order, bucket, part, salt, before, rank = (free_name(df, name) for name in ("order", "bucket", "part", "salt", "before", "rank"))
    keyed = (df.withColumn("shard", rendezvous(key, weights, seed))
             .withColumn(order, _digest(key, seed))
             .withColumn(bucket, F.shiftright(F.conv(F.substring(order, 1, 8), 16, 10).cast("long") * F.lit(buckets), 32)))
    if grown_weights is not None:
        keyed = keyed.withColumn("grown_shard", rendezvous(key, grown_weights, seed))
    sizes = materialise(keyed.groupBy("shard", bucket).agg(F.count("*").alias(rank)))  # a row per shard and bucket
    crowded = sizes.filter(F.col(rank) > 2 * rows_per_bucket).select("shard", bucket)
    group = ["shard", bucket]
    if crowded.limit(1).count():
        hot = materialise(keyed.join(crowded, group, "left_semi").groupBy(*group, order).agg(F.count("*").alias(rank))
                          .filter(F.col(rank) > rows_per_bucket))
        lists = hot.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(order, rank))).alias(before))
        # Parts of a bucket in its order: rows before a hot key, the hot key's own rows, rows up to the next one.
        own = F.filter(before, lambda one: one[order] == F.col(order))
        number = F.coalesce(2 * F.size(F.filter(before, lambda one: one[order] < F.col(order))) + F.size(own), F.lit(0))
        placed = (keyed.join(lists, group, "left").withColumn(part, number)
                  .withColumn(rank, F.ceil(F.get(own, F.lit(0))[rank] / rows_per_bucket)).drop(before))
        spot = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col(rank))
        hot_rows = materialise(placed.filter(F.col(part) % 2 == 1).withColumn(salt, spot).drop(rank))
        keyed = placed.filter(F.col(part) % 2 == 0).drop(rank).withColumn(salt, F.lit(0).cast("long")).unionByName(hot_rows)
        group = ["shard", bucket, part, salt]
        sizes = keyed.groupBy(*group).agg(F.count("*").alias(rank))
    earlier = Window.partitionBy("shard").orderBy(*group[1:]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*group, F.coalesce(F.sum(rank).over(earlier), F.lit(0)).alias(before))
    turn = F.row_number().over(Window.partitionBy(*group).orderBy(order, key))
    return (keyed.withColumn(rank, turn).join(offsets, group).withColumn("slot", F.col(before) + F.col(rank) - 1)
            .drop(order, before, rank, *group[1:]))
