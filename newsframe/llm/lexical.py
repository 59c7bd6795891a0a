"""Ranked lexical search with bags of words: equal documents are scored once.

Documents are restricted to the words of the queries. Those with the same counts of these words and the same length
class form one class, whatever their other words are; classes are found by a hash and told apart by the counts
themselves. Each class is scored once for every query, and the best classes are expanded to their documents.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from newsframe.llm.decontamination import item_words
from newsframe.session import free_shuffles, materialise

CLASSES_PER_BLOCK = 4096
ITEM_WORDS_PER_BLOCK = 100_000
CELLS = 4_000_000  # counts that a task spreads over a dense table at a time


def _bags(docs: DataFrame, vocabulary: DataFrame, key: str, text: str) -> DataFrame:
    """(row, doc, n, words, counts): every document, its number of terms, and its counts of the listed words by word number."""
    words = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("doc"), item_words(text).alias("words"))
    # Documents without terms, and terms that no query has, stay as rows without a number.
    terms = words.select("row", "doc", F.size("words").cast("long").alias("n"), F.explode_outer("words").alias("word"))
    counts = terms.join(vocabulary, "word", "left").groupBy("row", "doc", "n", "number").agg(F.count("*").alias("tf"))
    cells = F.array_sort(F.collect_list(F.when(F.col("number").isNotNull(), F.struct("number", F.col("tf").cast("int").alias("tf")))))
    return counts.groupBy("row", "doc", "n").agg(cells.alias("cells")).select(
        "row", "doc", "n", F.col("cells.number").alias("words"), F.col("cells.tf").alias("counts"))


def block_scores(words: np.ndarray, counts: np.ndarray, owner: np.ndarray, m: np.ndarray, item_words: np.ndarray,
                 item_starts: np.ndarray, weights: np.ndarray, k: int, heads: np.ndarray):
    """The ``k`` best classes of every query: query number, class number and score, all above 0; ties by ``heads``.

    ``words``, ``counts`` and ``owner`` are the cells of the classes, ``item_words`` the distinct words of one query
    after the other. All sums are whole numbers.
    """
    listed, place = np.unique(item_words, return_inverse=True)
    at = np.minimum(np.searchsorted(listed, words), max(len(listed) - 1, 0))
    known = listed[at] == words if len(listed) else np.zeros(len(words), bool)
    at, tf, own = at[known], counts[known].astype(np.int64), owner[known]
    value = weights[listed[at]] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[own]))
    found = []
    step = max(1, CELLS // max(len(listed), 1))
    borders = np.searchsorted(own, np.arange(0, len(m) + step, step))
    ends = np.append(item_starts[1:], len(item_words))
    for number, first in enumerate(range(0, len(m), step)):
        size = min(step, len(m) - first)
        dense = np.zeros((len(listed), size), np.int64)
        cells = slice(borders[number], borders[number + 1])
        dense[at[cells], own[cells] - first] = value[cells]
        for query, (one, two) in enumerate(zip(item_starts.tolist(), ends.tolist(), strict=True)):
            score = dense[place[one:two]].sum(0)
            best = np.flatnonzero(score > 0)
            if len(best) > k:  # all that reach the k-th score, so that ties are broken by the head alone
                best = best[score[best] >= np.partition(score[best], -k)[-k]]
            best = best[np.lexsort((heads[first + best], -score[best]))][:k]
            found.append((np.full(len(best), query), best + first, score[best]))
    query, cls, score = (np.concatenate([one[at] for one in found]) if found else np.zeros(0, np.int64) for at in range(3))
    order = np.lexsort((heads[cls], -score, query))
    query, cls, score = query[order], cls[order], score[order]
    start = np.searchsorted(query, query)
    keep = np.arange(len(query)) - start < k
    return query[keep], cls[keep], score[keep]


def ranked_documents(docs: DataFrame, items: DataFrame, k: int = 50, key: str = "doc_id", text: str = "text",
                     item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item, rank, doc, score): the ``k`` documents with the highest scores above 0 for every item.

    Terms are runs of digits, ASCII letters and non-ASCII characters, A-Z lower-cased. With N documents with a term,
    their L terms, n terms of the document and df documents with the term, a term weighs
    w = floor(1000 * ln((2N + 2) / (2 df + 1))), m = 50 + (50 * n * N) div L, and the score is the sum over the item's
    distinct terms of w * ((10^9 * tf) div (1000 * tf + 20 * m)). Equal scores follow the key.

    Null texts have no terms. Rows with equal keys are documents of their own; a null key comes last among equal scores.
    Items with equal ids are ranked each by its own text (and share the id); an item without terms, and an empty table,
    give no rows. Other columns are ignored.

    Nothing of the size of the documents is sent to all tasks. Classes meet the items in blocks of both; a task returns
    ``k`` classes for each of its items, which is enough: every class before the one of a ranked document holds a
    document that comes before it. A class of a third of all documents keeps its ``k`` least keys, found in every task
    before the shuffle.
    """
    spark = docs.sparkSession
    words = F.explode(F.array_distinct(item_words(item_text))).alias("word")
    asked = materialise(items.select(F.monotonically_increasing_id().alias("item"), F.col(item_key).alias("id"), F.col(item_text).alias(item_text)))
    pairs = materialise(asked.select("item", words))
    vocabulary = materialise(pairs.groupBy("word").count().select("word", F.xxhash64("word").alias("number")))
    twice = vocabulary.groupBy("number").count().filter("count > 1").limit(1).count()
    if twice:  # never seen; numbers by rank are exact, at the price of a sort
        vocabulary = materialise(vocabulary.select("word", F.row_number().over(Window.orderBy("word")).cast("long").alias("number")))
    bags = materialise(_bags(docs, vocabulary, key, text))
    free_shuffles(spark)
    n_docs, n_terms = bags.filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(1))).first()

    df = bags.select(F.explode("words").alias("number")).groupBy("number").agg(F.count("*").alias("df"))
    ratio = (2.0 * n_docs + 2) / (2 * F.col("df") + 1)
    weights = materialise(df.select("number", F.floor(1000 * F.log(ratio)).cast("long").alias("w")))
    m = F.lit(50).cast("long") + F.expr(f"(50 * n * {n_docs}L) div {max(n_terms, 1)}L")
    useful = bags.filter(F.size("words") > 0).select("row", "doc", m.alias("m"), "words", "counts")
    useful = useful.withColumn("hash", F.xxhash64("m", "words", "counts"))
    # The counts themselves stand behind the hash in the grouping, so unlike documents with one hash stay apart.
    alike = Window.partitionBy("hash", "m", "words", "counts").orderBy(F.col("doc").asc_nulls_last(), "row")
    members = materialise(useful.withColumn("turn", F.row_number().over(alike)).withColumn("class", F.first("row").over(alike))
                          .filter(F.col("turn") <= k))
    heads = members.filter("turn = 1").select("class", "doc", "m", "words", "counts")
    free_shuffles(spark)

    blocks = max(1, -(-heads.count() // CLASSES_PER_BLOCK))
    groups = max(1, -(-pairs.count() // ITEM_WORDS_PER_BLOCK))
    known = pairs.join(vocabulary, "word").join(weights, "number")
    # Items are repeated for every block of classes, and classes for every 100,000 words of items.
    right = (known.select("item", "number", "w", F.pmod(F.xxhash64("item"), F.lit(groups)).alias("group"))
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    left = (heads.withColumn("block", F.pmod(F.xxhash64("class"), F.lit(blocks)).cast("int"))
            .withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))))

    def score(classes: pa.Table, queries: pa.Table) -> pa.Table:
        if not classes.num_rows or not queries.num_rows:
            return result.empty_table()
        queries = queries.sort_by([("item", "ascending"), ("number", "ascending")])
        classes = classes.sort_by("class").combine_chunks()
        item, number, w = (queries.column(name).to_numpy() for name in ("item", "number", "w"))
        starts = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1])))
        listed, first, where = np.unique(number, return_index=True, return_inverse=True)
        cells = classes.column("words").combine_chunks()
        sizes = np.diff(cells.offsets.to_numpy())
        flat = cells.flatten().to_numpy()
        tf = classes.column("counts").combine_chunks().flatten().to_numpy()
        owner = np.repeat(np.arange(len(sizes)), sizes)
        place = np.minimum(np.searchsorted(listed, flat), len(listed) - 1)
        hit = listed[place] == flat
        query, cls, found = block_scores(place[hit], tf[hit], owner[hit], classes.column("m").to_numpy(), where.ravel(), starts, w[first], k,
                                         _rank(classes.column("doc")))
        return pa.table({"item": pa.array(item[starts][query]), "class": classes.column("class").take(pa.array(cls)),
                         "score": pa.array(found), "head": classes.column("doc").take(pa.array(cls))}, schema=result)

    kind = heads.schema["doc"].dataType
    result = pa.schema([("item", pa.int64()), ("class", pa.int64()), ("score", pa.int64()), ("head", to_arrow_type(kind))])
    scored = left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInArrow(
        score, f"item long, class long, score long, head {kind.simpleString()}")
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.col("head").asc_nulls_last(), "class")
    top = scored.withColumn("turn", F.row_number().over(best)).filter(F.col("turn") <= k).select("item", "class", "score")
    final = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc").asc_nulls_last(), "row")
    ranked = (top.join(members.select("class", "doc", "row"), "class").withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k))
    return ranked.join(asked.select("item", "id"), "item").select(
        F.col("id").alias(item_key), "rank", F.col("doc").alias(key), "score")


def _rank(keys: pa.ChunkedArray) -> np.ndarray:
    """Places of the keys in ascending order, nulls last; equal keys have equal places."""
    return pc.rank(keys.combine_chunks(), sort_keys="ascending", null_placement="at_end", tiebreaker="min").to_numpy(zero_copy_only=False)
