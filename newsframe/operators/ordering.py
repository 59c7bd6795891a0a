"""Positions, order statistics and per-group samples without a window over a large group.

A window partitioned by a class or by nothing sends a third of all rows, or all of them, to one task. The operators
here count rows in key ranges first; the small count tables decide which range holds the wanted row.
"""

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsframe.session import materialise

FAN_OUT = 16384  # key ranges per counting round


def hash_key(seed: int, *keys: Column) -> Column:
    """Reproducible random key: md5 of seed and row key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[key.cast("string") for key in keys]))


def _bucketed_index(df: DataFrame, order: list, bucket: str, name: str) -> DataFrame:
    """Dense index from 0 in the order of (bucket, order) for buckets that follow the order."""
    sizes = df.groupBy(bucket).agg(F.count("*").alias("_size"))
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(bucket, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy(bucket).orderBy(*order))
    # One row per bucket, and the number of buckets is set by the caller: safe to broadcast.
    return (df.withColumn("_rank", rank).join(F.broadcast(offsets), bucket)
            .withColumn(name, F.col("_before") + F.col("_rank") - 1).drop(bucket, "_rank", "_before"))


def dense_index(df: DataFrame, key: str, name: str = "row_id", buckets: int | None = None) -> DataFrame:
    """Adds 0..n-1 in the order of a unique numeric key.

    Quantiles of the key split the rows into ranges of similar size; rows are numbered inside their range and
    shifted by the size of the ranges before it.
    """
    spark = df.sparkSession
    count = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = df.approxQuantile(key, [i / count for i in range(1, count)], 1 / (4 * count))
    splits = [-float("inf"), *sorted(set(cuts)), float("inf")]
    keyed = df.withColumn("_key", F.col(key).cast("double"))
    ranged = Bucketizer(splits=splits, inputCol="_key", outputCol="_bucket").transform(keyed).drop("_key")
    return _bucketed_index(ranged, [key], "_bucket", name)


def range_index(df: DataFrame, order: list, name: str = "row_id") -> DataFrame:
    """Adds 0..n-1 in the order of any sortable columns (names or ``F.desc`` columns) that tell all rows apart.

    One range shuffle; every range numbers its own rows, and the sizes of the ranges before shift them.
    """
    ranged = materialise(df.repartitionByRange(*order).withColumn("_bucket", F.spark_partition_id()))
    return _bucketed_index(ranged, order, "_bucket", name)


def first_rows(df: DataFrame, n: int, order: str) -> DataFrame:
    """The first n rows in the order of a column, without sending n rows of every task to one task.

    For a whole-number key the n-th key is found by counting, and the rows up to it stay where they are; of rows that
    share it as many are taken as are missing. Any other key is numbered in a range shuffle. Missing keys come first.
    """
    if df.schema[order].dataType.typeName() not in ("byte", "short", "integer", "long"):
        return range_index(df.withColumn("_tie", F.monotonically_increasing_id()), [order, "_tie"], "_at").filter(
            F.col("_at") < n).drop("_at", "_tie")
    missing = df.filter(F.col(order).isNull()).limit(n)
    rest = n - missing.count()
    known = df.filter(F.col(order).isNotNull())
    border = nth_keys(known, order, {None: rest})[None] if rest > 0 else None
    if border is None:
        return missing.unionByName(known) if rest > 0 else missing
    below = known.filter(F.col(order) < border)
    return missing.unionByName(below).unionByName(known.filter(F.col(order) == border).limit(rest - below.count()))


def shuffled_index(df: DataFrame, keys: list[str], seed: int = 0, name: str = "position") -> DataFrame:
    """Adds a random permutation 0..n-1 (order of the md5 key); the first md5 digits make even ranges."""
    keyed = df.withColumn("_hash", hash_key(seed, *[F.col(key) for key in keys])).withColumn(
        "_bucket", F.substring("_hash", 1, 4))
    return _bucketed_index(keyed, ["_hash", *keys], "_bucket", name).drop("_hash")


def shuffle_rows(df: DataFrame, keys: list[str], seed: int = 0) -> DataFrame:
    """All rows in random but reproducible order (one range shuffle)."""
    return df.orderBy(hash_key(seed, *[F.col(key) for key in keys]), *keys)


def file_order_index(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Adds 0..n-1 in the order of file name and row in file, for a frame read directly from Parquet.

    The reader knows the row number inside each file, so only one count per file is shuffled.
    """
    tagged = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    sizes = tagged.groupBy("_file").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialise(sizes.select("_file", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before")))
    return (tagged.join(offsets, "_file").withColumn(name, F.col("_before") + F.col("_row"))
            .drop("_file", "_row", "_before"))


def nth_keys(df: DataFrame, key: str, wanted: dict, label: str | None = None,
             bounds: tuple[int, int] | None = None) -> dict:
    """Key of the n-th row (in key order) of each label: ``{label: n} -> {label: key or None}``.

    ``label=None`` takes all rows as one group, under the name None. The key is a unique whole number. Each round
    counts rows in at most 16,384 key ranges per label and keeps the range with the wanted row, so the driver sees
    16,384 numbers per label and a 64-bit key is found in at most five scans of the two columns. ``bounds`` are the
    smallest and the largest key, if they are known.
    """
    name = F.lit(None).cast("string") if label is None else F.col(label).cast("string")
    rows = df.select(name.alias("_label"), F.col(key).cast("long").alias("_key"))
    names = {None if label is None else _text(value): value for value in wanted}
    if label is not None:
        rows = rows.filter(F.col("_label").isin(list(names)))
    low, high = bounds or rows.agg(F.min("_key"), F.max("_key")).first()
    found = {value: None for value in wanted}
    if low is None:
        return found
    todo = {text: (low, high + 1, wanted[value]) for text, value in names.items() if wanted[value] > 0}
    while todo:
        ranges = {text: (start, max(1, -(-(end - start) // FAN_OUT)), end) for text, (start, end, _) in todo.items()}
        bucket, inside = F, F.lit(False)
        for text, (start, width, end) in ranges.items():
            mine = F.col("_label").eqNullSafe(F.lit(text)) & (F.col("_key") >= start) & (F.col("_key") < end)
            bucket = bucket.when(mine, F.floor((F.col("_key") - start) / width))
            inside = inside | mine
        counts: dict = {}
        for text, at, size in (rows.filter(inside).groupBy("_label", bucket.alias("_at"))
                               .agg(F.count("*")).collect()):
            counts.setdefault(text, []).append((at, size))
        next_round = {}
        for text, (start, width, _) in ranges.items():
            rest = todo[text][2]
            for at, size in sorted(counts.get(text, [])):
                if rest <= size:
                    if width == 1:
                        found[names[text]] = start + at
                    else:
                        next_round[text] = (start + at * width, start + (at + 1) * width, rest)
                    break
                rest -= size
        todo = next_round
    return found


def _text(value) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def group_index(df: DataFrame, group: str, keys: list[str], seed: int = 0, name: str = "position") -> DataFrame:
    """Adds 0..n-1 in random but reproducible order inside every group; no group is sorted in one task."""
    keyed = df.withColumn("_hash", hash_key(seed, *[F.col(key) for key in keys])).withColumn("_bucket", F.substring("_hash", 1, 4))
    sizes = keyed.groupBy(group, "_bucket").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(group, "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy(group, "_bucket").orderBy("_hash", *keys))
    return (join_groups(keyed.withColumn("_rank", rank), offsets, [group, "_bucket"])
            .withColumn(name, F.col("_before") + F.col("_rank") - 1).drop("_hash", "_bucket", "_rank", "_before"))


def sample_per_group(df: DataFrame, group: str, keys: list[str], n: int, seed: int = 0) -> DataFrame:
    """``min(n, group size)`` random rows of every non-missing group, reproducible by seed.

    The rows with the smallest md5 keys win. Counts per (group, first four md5 digits) tell which digits hold the
    n-th row; only rows up to those digits are moved, and they are ranked per (group, digits).
    """
    keyed = (df.filter(F.col(group).isNotNull())
             .withColumn("_hash", hash_key(seed, *[F.col(key) for key in keys]))
             .withColumn("_bucket", F.substring("_hash", 1, 4)))
    sizes = keyed.groupBy(group, "_bucket").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    running = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    # Written once, so that the join below knows its size: small samples are looked up without moving the rows.
    wanted = materialise(running.filter(F.col("_before") < n).select(group, "_bucket", "_before"))
    rank = F.row_number().over(Window.partitionBy(group, "_bucket").orderBy("_hash", *keys))
    return (keyed.join(wanted, [group, "_bucket"]).withColumn("_rank", rank)
            .filter(F.col("_before") + F.col("_rank") <= n).drop("_hash", "_bucket", "_before", "_rank"))


def file_number(index: Column, rows_per_file: int = 10000, digits: int = 3) -> Column:
    """Number of the file a row falls into, counted from 001."""
    number = (F.floor(index / rows_per_file) + 1).cast("string")
    return F.when(F.length(number) >= digits, number).otherwise(F.lpad(number, digits, "0"))


def distinct_values(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., value, size): how often each number occurs per group, written once for several summaries."""
    counts = df.groupBy(*by, F.col(value).cast("double").alias("value")).agg(F.count("*").alias("size"))
    # The filter comes after the write; before it, Spark would compute the value a second time to test it.
    return materialise(counts).filter(F.col("value").isNotNull())


def quantiles(df: DataFrame, by: list[str], value: str, probabilities: list[float]) -> DataFrame:
    """Exact interpolated quantiles per group: (by..., probability, quantile)."""
    return quantiles_of(distinct_values(df, by, value), by, probabilities)


def quantiles_of(values: DataFrame, by: list[str], probabilities: list[float], ranges: int = 256) -> DataFrame:
    """The same for a table from ``distinct_values``.

    Approximate quantiles split the values of every group into ranges; their sizes tell which ranges hold the wanted
    rows, and only those are sorted.
    """
    shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    groups = values.groupBy(*by).agg(
        F.sum("size").alias("_n"), F.array_distinct(F.percentile_approx("value", shares, 4 * ranges)).alias("_cuts"))
    at = F.size(F.filter("_cuts", lambda cut: cut < F.col("value")))
    placed = join_groups(values, groups, by).select(*by, "value", "size", "_n", at.alias("_range"))
    sizes = placed.groupBy(*by, "_n", "_range").agg(F.sum("size").alias("_size"))
    upto = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = sizes.withColumn("_before", F.sum("_size").over(upto) - F.col("_size"))
    ranks = F.array(*[F.struct(F.lit(p).alias("p"), (F.lit(p) * (F.col("_n") - 1)).alias("h")) for p in probabilities])
    ends = (sizes.withColumn("_rank", F.explode(ranks))
            .select(*by, "_range", "_size", "_before", F.col("_rank.p").alias("probability"), F.col("_rank.h").alias("_h"))
            .withColumn("_row", F.explode(F.array_distinct(F.array(F.floor("_h"), F.ceil("_h")))))
            .filter((F.col("_row") >= F.col("_before")) & (F.col("_row") < F.col("_before") + F.col("_size"))))
    wanted = ends.groupBy(*by, "_range", "_before").agg(
        F.collect_list(F.struct("probability", "_h", "_row")).alias("_wanted"))
    inside = (Window.partitionBy(*by, "_range").orderBy("value")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    hits = (join_groups(placed.drop("_n"), wanted, [*by, "_range"])
            .withColumn("_end", F.col("_before") + F.sum("size").over(inside))
            .withColumn("_hit", F.explode(F.filter(
                "_wanted", lambda w: (w["_row"] < F.col("_end")) & (w["_row"] >= F.col("_end") - F.col("size"))))))
    low, high = F.min("value"), F.max("value")
    return hits.groupBy(*by, F.col("_hit.probability").alias("probability")).agg(
        (low + (high - low) * F.max(F.col("_hit._h") - F.floor(F.col("_hit._h")))).alias("quantile"))


def join_groups(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Equi-join on group columns where missing values match each other."""
    names = {name: f"_right_{name}" for name in on}
    other = right.withColumnsRenamed(names)
    matches = [F.col(name).eqNullSafe(F.col(renamed)) for name, renamed in names.items()]
    condition = matches[0]
    for match in matches[1:]:
        condition = condition & match
    return left.join(other, condition).drop(*names.values())
