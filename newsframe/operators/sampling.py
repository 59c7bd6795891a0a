"""Quota splits and stratified batches."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsframe.functions.labels import ARTICLE_TYPES
from newsframe.operators.ordering import hash_key, nth_keys, sample_per_group

__all__ = ["quota_split", "continue_split", "split_report", "sample_per_group", "sample_summary", "merge_summaries"]


def _quotas(total_size: int, splits: list[float], balanced: list[bool], classes: list) -> list[int]:
    # The products are cut off, not rounded.
    return [int((share * total_size) / len(classes)) if even else int(share * total_size)
            for share, even in zip(splits, balanced)]


def quota_split(df: DataFrame, total_size: int, splits: list[float], balanced: list[bool], key: str,
                label: str = "type", classes: list | None = None, end_col: str = "set",
                delete: bool = True) -> DataFrame:
    """Fills the sets 0, 1, 2, ... one after the other with rows in key order and writes the set number.

    An unbalanced set takes the next ``share * total_size`` rows; a balanced one takes an equal number of rows of
    each class and loses the surplus rows it meets before its last class is full. Rows of no set are dropped, or
    kept with a missing set number when ``delete`` is false. ``key`` is a unique whole number.

    The set borders are order statistics of the key, found by counting. The rows themselves are tagged in a scan; only
    the keys are shuffled once, to make sure that they are unique.
    """
    return continue_split(df, total_size, splits, balanced, key, (0, {}), label, classes, end_col, delete)[0]


def continue_split(df: DataFrame, total_size: int, splits: list[float], balanced: list[bool], key: str, state: tuple[int, dict],
                   label: str = "type", classes: list | None = None, end_col: str = "set", delete: bool = True) -> tuple[DataFrame, tuple[int, dict]]:
    """The rows of ``quota_split`` with its state behind the last row: the number of the open set, and its rows so far by class.

    A table that comes in parts gets the sets of the whole table, in the order of the parts and of the keys inside each, if
    every part starts with the state that the one before has left: (0, {}) for the first. The counts of a set without
    classes have the name None. Behind the last set the number is that of the sets, and no row of a later part is taken.
    """
    classes = list(ARTICLE_TYPES if classes is None else classes)
    rows = df.select(F.col(key), F.col(label)).persist()
    if rows.groupBy(key).count().filter("count > 1").limit(1).count():
        raise ValueError(f"{key} must be unique: rows that share a key cannot be told apart at a quota's border")
    low, high = rows.agg(F.min(key), F.max(key)).first()
    start, number = low, F
    (at, filled), quotas = state, _quotas(total_size, splits, balanced, classes)
    chosen = F.coalesce(F.col(label).isin(classes), F.lit(False))

    while start is not None and at < len(quotas):
        names = classes if balanced[at] else [None]
        rest = {value: quotas[at] - filled.get(value, 0) for value in names if quotas[at] > filled.get(value, 0)}
        after = F.col(key) >= start
        left = rows.filter(after)
        last = nth_keys(left, key, rest, label if balanced[at] else None, (start, high)) if rest else {}
        member = F.lit(False)
        for value, border in last.items():
            fits = F.lit(True) if value is None else F.col(label) == F.lit(value)
            member = member | (fits if border is None else fits & (F.col(key) <= border))
        if last:
            number = number.when(after & member, F.lit(at))
        if None in last.values():
            # A class that is short of its quota keeps the set open up to the end of the rows.
            got = {row[0]: row[1] for row in left.filter(member).groupBy(label).agg(F.count("*")).collect()} if balanced[at] else {None: left.count()}
            filled, start = {value: filled.get(value, 0) + got.get(value, 0) for value in names}, None
        elif balanced[at]:
            # The set is left at the first row of one of its classes behind its last border.
            behind = F.col(key) > max(last.values()) if last else after
            start = left.filter(behind & chosen).agg(F.min(key)).first()[0]
            at, filled = (at, dict.fromkeys(names, quotas[at])) if start is None else (at + 1, {})
        else:
            at, filled, start = at + 1, {}, last[None] + 1 if last else start
    rows.unpersist()
    tagged = df.withColumn(end_col, F.lit(None).cast("int") if number is F else number.otherwise(None).cast("int"))
    return tagged.filter(F.col(end_col).isNotNull()) if delete else tagged, (at, filled)


def sample_summary(df: DataFrame, group: str, keys: list[str], n: int, seed: int = 0) -> DataFrame:
    """The columns with ``place``: of every non-missing group the rows with the ``n`` least places, a mergeable sample.

    The place is the md5 of seed and keys, so summaries of parts of a table can be merged, in any order and with any
    overlap of parts: the merged summary of all parts is that of the whole table, and its rows are those of
    ``sample_per_group``. Each task keeps ``n`` rows of a group before anything is moved, so a summary needs one pass.
    Rows with equal keys count as one; a summary of a summary is the same.
    """
    placed = df.filter(F.col(group).isNotNull()).withColumn("place", hash_key(seed, *[F.col(key) for key in keys]))
    return _least(placed, group, keys, n)


def merge_summaries(parts: list[DataFrame], group: str, keys: list[str], n: int) -> DataFrame:
    """One summary from those of several parts or batches."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return _least(whole, group, keys, n)


def _least(placed: DataFrame, group: str, keys: list[str], n: int) -> DataFrame:
    # dense_rank, so that copies of a row do not take the place of others; Spark cuts groups in every task before it moves rows.
    order = Window.partitionBy(group).orderBy("place", *keys)
    return placed.withColumn("_rank", F.dense_rank().over(order)).filter(F.col("_rank") <= n).drop("_rank").dropDuplicates([group, "place", *keys])


def split_report(split: DataFrame, total_size: int, splits: list[float], balanced: list[bool],
                 label: str = "type", classes: list | None = None, end_col: str = "set") -> DataFrame:
    """Rows wanted and got per set, and per class in balanced sets; short sets show got < wanted."""
    classes = list(ARTICLE_TYPES if classes is None else classes)
    wanted = []
    for index, (quota, even) in enumerate(zip(_quotas(total_size, splits, balanced, classes), balanced)):
        wanted += [(index, str(value).lower() if isinstance(value, bool) else str(value), quota)
                   for value in classes] if even else [(index, None, quota)]
    even_sets = [index for index, even in enumerate(balanced) if even]
    name = F.when(F.col(end_col).isin(even_sets), F.col(label).cast("string")) if even_sets else F.lit(None).cast("string")
    got = (split.filter(F.col(end_col).isNotNull()).groupBy(F.col(end_col).alias("_set"), name.alias("_label"))
           .agg(F.count("*").alias("got")))
    table = split.sparkSession.createDataFrame(wanted, "set int, label string, wanted long")
    return (table.join(got, (F.col("set") == F.col("_set")) & F.col("label").eqNullSafe(F.col("_label")), "left")
            .select("set", "label", "wanted", F.coalesce("got", F.lit(0)).alias("got")))
