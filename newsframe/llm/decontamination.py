"""Benchmark decontamination: a prefix-filtered join of benchmark windows with the documents' shingles."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsframe.llm.common import lower_ascii, text_or_empty
from newsframe.session import materialise

WINDOW = 13
SHINGLE = 3
NO_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"  # every ASCII character but digits and a-z


def item_words(text: str) -> Column:
    """Runs of digits, letters and non-ASCII characters, A-Z lower-cased; none for null."""
    return F.array_remove(F.split(lower_ascii(text_or_empty(text)), NO_WORD), "")


def benchmark_windows(items: DataFrame, key: str, text: str, width: int = WINDOW) -> DataFrame:
    """(words, items): every distinct window of ``width`` words with the ids of its items, as text.

    An item of fewer words, but not none, is one window. The list of a window is at most as long as the benchmark.
    """
    words = items.select(F.col(key).cast("string").alias("item"), item_words(text).alias("all")).filter(F.size("all") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("all") - width, F.lit(0)))
    windows = words.select("item", "all", F.explode(starts).alias("start"))
    return (windows.select("item", F.slice("all", F.col("start") + 1, F.lit(width)).alias("words"))
            .groupBy("words").agg(F.collect_set("item").alias("items")))


def _shingle(words: Column, at: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *[F.get(words, at + step) for step in range(size)])


def _positions(rows: DataFrame, columns: list[str], sizes: list[int]) -> DataFrame:
    """(columns..., at, shingle): one row per word position and shingle size, without the words."""
    hashes = [_shingle(F.col("words"), F.col("at"), size) for size in sizes]
    placed = rows.select(*columns, "words", F.posexplode("words").alias("at", "word"))
    if len(hashes) == 1:
        return placed.select(*columns, "at", hashes[0].alias("shingle"))
    return placed.select(*columns, "at", F.explode(F.array(*hashes)).alias("shingle"))


def benchmark_hits(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                   item_text: str = "text", width: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: key, n_words, n_hit, n_items, items_sha256, contaminated, text_hash.

    A document word inside any occurrence of a benchmark window is hit; n_items counts items with occurring windows;
    contaminated: n_hit > 0 and 20 * n_hit >= n_words.

    The shingles of the windows are counted in all documents. A window can only occur where its rarest shingle does,
    so that one alone is joined (the prefix that full containment needs), and a window with a shingle that never
    occurs is dropped. The shingle's place gives the window's start; starts before the text or windows beyond its
    end are dropped, and the rest is brought back to its text and compared word by word.

    The plan is the same for a benchmark of any size. What is joined by shingle is a place and two numbers for its text, no
    words; Spark sends the stored table of windows to them only below its own broadcast threshold in bytes. Texts with a
    possible window, named by hash and number of words, are then read again. Their spans come back to all rows of the text.

    Null texts have no words and are clean; repeated rows and keys get a row each; an empty benchmark hits nothing;
    a null item id hits words but is not listed. Other columns are ignored.
    """
    windows = materialise(benchmark_windows(items, item_key, item_text, width).withColumn("window", F.monotonically_increasing_id()))
    offset = F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - shingle, F.lit(0)))).alias("offset")
    parts = windows.select("window", F.size("words").alias("length"), "words", F.least(F.size("words"), F.lit(shingle)).alias("size"), offset)
    hashed = F.lit(None).cast("long")
    for size in range(1, shingle + 1):
        hashed = F.when(F.col("size") == size, _shingle(F.col("words"), F.col("offset"), size)).otherwise(hashed)
    parts = materialise(parts.withColumn("shingle", hashed).drop("words"))
    sizes = sorted(row["size"] for row in parts.select("size").distinct().collect()) or [shingle]  # 1 .. shingle

    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text_or_empty(text)).alias("text_hash"), item_words(text).alias("words")).withColumn(
        "n_words", F.size("words"))
    known = materialise(parts.select("shingle").distinct())
    counts = _positions(rows, [], sizes).join(known, "shingle").groupBy("shingle").agg(F.count("*").alias("count"))
    rarest = (parts.join(counts, "shingle", "left").groupBy("window", "length")
              .agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "shingle", "offset")).alias("least"))
              .filter("least.count > 0"))
    prefix = materialise(rarest.select("window", "length", "least.shingle", "least.offset"))

    start = F.col("at") - F.col("offset")
    text_id = ["text_hash", "n_words"]
    possible = materialise(_positions(rows, text_id, sizes).join(prefix, "shingle").select(*text_id, "window", "length", start.alias("start"))
                           .filter("start >= 0 and start + length <= n_words").select(*text_id, "window", "start").distinct())
    # Equal texts are compared once for each place; which texts have to be is a short list as long as the benchmark is rare.
    judged = materialise(possible.select(*text_id).distinct())
    compared = (rows.select(*text_id, "words").join(judged, text_id, "left_semi").dropDuplicates(text_id).join(possible, text_id)
                .join(windows.select("window", F.col("words").alias("wanted"), "items"), "window"))
    length = F.size("wanted")
    found = compared.filter(F.slice("words", F.col("start") + 1, length) == F.col("wanted"))
    spans = materialise(found.groupBy(*text_id).agg(F.collect_set(F.struct("start", length.alias("length"))).alias("spans"), F.collect_set("items").alias("lists")))
    grouped = (rows.select(F.col("key").alias("__key"), *text_id).join(spans, text_id, "left").withColumn("n_words", F.col("n_words").cast("long"))
               .withColumn("spans", F.coalesce("spans", F.array())).withColumn("lists", F.coalesce("lists", F.array())))
    covered = F.aggregate(
        F.array_sort("spans"), F.struct(F.lit(0).alias("reach"), F.lit(0).cast("long").alias("total")),
        lambda acc, span: F.struct(
            F.greatest(acc["reach"], span["start"] + span["length"]).alias("reach"),
            (acc["total"] + F.greatest(F.lit(0), span["start"] + span["length"] - F.greatest(acc["reach"], span["start"]))).alias("total")),
        lambda acc: acc["total"])
    listed = F.array_sort(F.array_distinct(F.flatten("lists")))
    return (grouped.withColumn("n_hit", covered).withColumn("listed", listed).select(
        F.col("__key").alias(key), "n_words", "n_hit", F.size("listed").cast("long").alias("n_items"),
        F.sha2(F.array_join("listed", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "text_hash"))


def drop_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents whose text is not contaminated; whether it is depends on the text alone."""
    marked = benchmark_hits(docs, items, key, text, **options).filter("contaminated").select("text_hash").distinct()
    bad = materialise(marked)
    return docs.join(bad, F.xxhash64(text_or_empty(text)) == bad["text_hash"], "left_anti")
