"""N-gram Jaccard join by group counts in R-trees.

Shingles are hashed into groups. Two sets of at most s shingles together that reach the similarity differ in at
most d = s * (1 - t) / (1 + t) shingles, so of more than d groups at least one has the same content in both: equal
contents route documents to the same bucket, and none is lost. Inside a bucket the counts of a second, fixed
grouping are points of an R-tree; the sum of the coordinate minima of two points, or of a point and the upper corner
of a node, bounds the overlap from above. Pairs of points that pass are bounded again by a grid with about one cell
for each shingle. What survives is verified on the shingles themselves.
"""

from functools import lru_cache
from math import ceil, exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsframe.llm.common import free_name
from newsframe.llm.components import connected_components
from newsframe.llm.textbytes import mix, shingle_sets, text_bytes
from newsframe.session import discard, free_shuffles, materialise

COORDINATES = 128
FINEST = 4096  # most cells of the second grid; its counts are 16-bit numbers, enough for 2^28 shingles
LEAF = 16
BLOCK_ROWS = 4096


def _reaches(overlap, total, num: int, den: int):
    """overlap / (total - overlap) >= num / den in whole numbers."""
    return den * overlap >= num * (total - overlap)


@lru_cache(maxsize=None)
def _size_class(number: int, num: int, den: int) -> tuple[int, int, int, int]:
    """Least size, greatest size of the class, greatest size of a partner, and number of groups, of a size class."""
    low = 1
    for _ in range(number):
        low = max(low + 1, ceil(low * 1.5))
    high = max(low + 1, ceil(low * 1.5)) - 1
    partner = high * den // num
    differ = (high + partner) * (den - num) // (den + num)
    groups = differ + 1
    for _ in range(8):  # spare groups for those that stay empty, so that empty groups rarely have to be compared
        empty = groups * exp(-low / groups)
        groups = differ + 1 + (ceil(empty + 3 * sqrt(empty)) if differ else 0)
    return low, high, partner, groups


def _classes(size: int, num: int, den: int) -> list[int]:
    """The size's own class and the lower ones that hold possible partners."""
    own = 0
    while _size_class(own, num, den)[1] < size:
        own += 1
    found = [own]
    while found[-1] and _size_class(found[-1] - 1, num, den)[2] >= size:
        found.append(found[-1] - 1)
    return found


def _signatures(shingles: np.ndarray, num: int, den: int) -> np.ndarray:
    """One hash for the content of every group, in every size class of the set."""
    found = []
    for number in _classes(len(shingles), num, den):
        low, high, partner, groups = _size_class(number, num, den)
        differ = (high + partner) * (den - num) // (den + num)
        group = ((mix(shingles, 11) >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)
        order = np.argsort(group)
        ordered = group[order]
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        content = np.add.reduceat(mix(shingles[order], 13), first)
        kind = np.uint64(number * 2 + 1)
        found.append(mix(content + mix(ordered[first], 17) * kind, 19))
        if groups - len(first) >= groups - differ:  # all groups that agree may be empty ones
            empty = np.setdiff1d(np.arange(groups, dtype=np.uint64), ordered)
            found.append(mix(mix(empty, 17) * kind, 23))
    return np.concatenate(found)


def _node(shingles: np.ndarray, seed: int) -> tuple[int, int]:
    """The number of a set, made of its content, and a second sum that tells two sets of one number apart."""
    total = mix(shingles, 3 + seed).sum() + np.uint64(len(shingles))
    return int(mix(np.array([total]), 7)[0].view(np.int64)), int(mix(shingles, 5).sum().view(np.int64))


def _set_keys(docs: DataFrame, words: int, seed: int) -> DataFrame:
    """(key, hash, n_shingles, node, check) for every row; an empty set has no node."""
    def keys(batches):
        for batch in batches:
            rows = [(len(s), *(_node(s, seed) if len(s) else (None, None))) for s in shingle_sets(*text_bytes(batch.column("text")), words)]
            columns = [pa.array([row[at] for row in rows], pa.int64()) for at in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("hash"), *columns], ["key", "hash", "n_shingles", "node", "check"])
    return docs.mapInArrow(keys, "key long, hash long, n_shingles long, node long, check long")


def _signature_rows(docs: DataFrame, words: int, num: int, den: int, seed: int) -> DataFrame:
    def signatures(batches):
        for batch in batches:
            sets = [s for s in shingle_sets(*text_bytes(batch.column("text")), words) if len(s)]
            rows = [_signatures(s, num, den) for s in sets]
            names = np.repeat(np.array([_node(s, seed)[0] for s in sets], np.int64), [len(row) for row in rows])
            flat = np.concatenate(rows).view(np.int64) if rows else np.zeros(0, np.int64)
            for at in range(0, len(flat), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(flat[at:at + 100_000]), pa.array(names[at:at + 100_000])],
                                                 ["signature", "node"])
    return docs.select("text").mapInArrow(signatures, "signature long, node long")


def grid(shingles: np.ndarray) -> np.ndarray:
    """Counts of a set in a grid with 128 to ``FINEST`` cells, a power of two of at least the set's size where possible.

    A coarser grid is the fold of a finer one.
    """
    cells = min(max(COORDINATES, 1 << (len(shingles) - 1).bit_length()), FINEST)
    return np.bincount((mix(shingles, 29) & np.uint64(cells - 1)).astype(np.int64), minlength=cells).astype("<u2")


def _fold(cells: np.ndarray, size: int) -> np.ndarray:
    return cells.reshape(-1, size).sum(0, dtype=np.int32) if len(cells) > size else cells.astype(np.int32)


def _set_rows(docs: DataFrame, wanted: DataFrame, words: int, seed: int, points: bool) -> DataFrame:
    """The wanted (key, hash, node): (node, counts, grid) if ``points``, else (node, cells), the shingles.

    A row that is there twice is there twice in the result, too, which no later step minds.
    """
    def rows(batches):
        for batch in batches:
            found, first = [], 0
            sets = shingle_sets(*text_bytes(batch.column("text")), words)
            for node, s in zip(batch.column("node").to_pylist(), sets, strict=True):
                first += 1
                if len(s) and _node(s, seed)[0] == node:
                    cells = grid(s) if points else s.view(np.int64)
                    found.append((node, _fold(cells, COORDINATES), cells.tobytes()) if points else (node, cells))
                if found and (len(found) == 200 or first == batch.num_rows):
                    columns = [pa.array([row[0] for row in found], pa.int64())]
                    columns.append(pa.array([row[1] for row in found], pa.list_(pa.int32() if points else pa.int64())))
                    if points:
                        columns.append(pa.array([row[2] for row in found], pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, ["node", "counts", "grid"] if points else ["node", "cells"])
                    found = []

    # What grows with the documents is never sent to all tasks, whatever its size is now: the plan is the same at every size.
    schema = "node long, counts array<int>, grid binary" if points else "node long, cells array<long>"
    return docs.join(wanted.hint("merge"), ["key", "hash"]).select("node", "text").mapInArrow(rows, schema)


def tree_pairs(counts: np.ndarray, side: np.ndarray, component: np.ndarray, num: int, den: int):
    """Index pairs of points in different components whose bounds admit the similarity, from an R-tree.

    ``side`` 0 and 1 are two blocks of one bucket; pairs are formed across them, or inside side 0 where there is
    only one. Points are packed into leaves in the order of size and heaviest coordinates; a node keeps the upper
    corner and the least size of its points, and a level of nodes above the leaves prunes leaves together.
    """
    sizes = counts.sum(1)
    crossing = bool(side.any())
    pool = np.flatnonzero(side == 1) if crossing else np.arange(len(counts))
    spread = counts[pool].var(0).argsort()[::-1][:2]
    pool = pool[np.lexsort((counts[pool][:, spread[1]], counts[pool][:, spread[0]] // 4, sizes[pool] // 8))]
    starts = np.arange(0, len(pool), LEAF)
    corner, least = np.maximum.reduceat(counts[pool], starts), np.minimum.reduceat(sizes[pool], starts)
    above = np.arange(0, len(starts), LEAF)
    top, top_least = np.maximum.reduceat(corner, above), np.minimum.reduceat(least, above)
    one, two = [], []
    for query in np.flatnonzero(side == 0):
        point, size = counts[query], sizes[query]
        nodes = np.flatnonzero(_reaches(np.minimum(top, point).sum(1), top_least + size, num, den))
        if not len(nodes):
            continue
        leaves = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
        leaves = leaves[leaves < len(starts)]
        leaves = leaves[_reaches(np.minimum(corner[leaves], point).sum(1), least[leaves] + size, num, den)]
        members = (leaves[:, None] * LEAF + np.arange(LEAF)).ravel()
        members = pool[members[members < len(pool)]]
        members = members[component[members] != component[query]]
        if not crossing:
            members = members[members > query]
        members = members[_reaches(np.minimum(counts[members], point).sum(1), sizes[members] + size, num, den)]
        one.append(np.full(len(members), query))
        two.append(members)
    return (np.concatenate(one), np.concatenate(two)) if one else (np.zeros(0, int), np.zeros(0, int))


def _fine(grids: list[np.ndarray], sizes: np.ndarray, left: np.ndarray, right: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which pairs the finer grid admits; each pair is compared in the coarser grid of its two."""
    kept, scale = np.zeros(len(left), bool), np.array([len(one) for one in grids])
    level = np.minimum(scale[left], scale[right]) if len(left) else np.zeros(0, int)
    for size in np.unique(level).tolist():
        pairs = np.flatnonzero(level == size)
        for at in range(0, len(pairs), step := max(1, (1 << 22) // size)):
            now = pairs[at:at + step]
            rows, place = np.unique(np.concatenate([left[now], right[now]]), return_inverse=True)
            folded = np.stack([_fold(grids[row], size) for row in rows.tolist()])
            bound = np.minimum(folded[place[:len(now)]], folded[place[len(now):]]).sum(1)
            kept[now] = _reaches(bound, sizes[left[now]] + sizes[right[now]], num, den)
    return kept


def _bucket_pairs(table: pa.Table, num: int, den: int) -> pa.RecordBatch:
    """Pairs of all whole buckets in the table, which is sorted by bucket; a bucket of one leaf is scanned at once."""
    name, side, nodes, component = (table.column(one).to_numpy() for one in ("bucket", "side", "node", "component"))
    grids = [np.frombuffer(one, "<u2") for one in table.column("grid").to_pylist()]
    counts = np.stack([_fold(one, COORDINATES) for one in grids])
    sizes = counts.sum(1)
    bucket = np.cumsum(np.concatenate(([0], name[1:] != name[:-1])))
    members = np.bincount(bucket, minlength=1)
    small = members[bucket] <= LEAF
    found = []
    for step in range(1, LEAF):
        left = np.flatnonzero(small[:-step] & (bucket[:-step] == bucket[step:]))
        right = left + step
        fits = (component[left] != component[right]) & _reaches(
            np.minimum(counts[left], counts[right]).sum(1), sizes[left] + sizes[right], num, den)
        found.append((left[fits], right[fits]))
    edges = np.concatenate(([0], np.cumsum(members)))
    for number in np.flatnonzero(members > LEAF):
        rows = slice(edges[number], edges[number + 1])
        one, two = tree_pairs(counts[rows], side[rows], component[rows], num, den)
        found.append((one + rows.start, two + rows.start))
    left, right = (np.concatenate([pair[at] for pair in found]) for at in range(2))
    fits = _fine(grids, sizes, left, right, num, den)
    left, right = left[fits], right[fits]
    pairs = np.unique(np.stack([np.maximum(nodes[left], nodes[right]), np.minimum(nodes[left], nodes[right])], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], ["a", "b"])


def _distinct_buckets(crowded: DataFrame) -> DataFrame:
    """(signature, members) of the buckets with two members or more; of those with equal members one is kept."""
    named = crowded.groupBy("signature").agg(F.count("*").alias("members"), F.bit_xor(F.xxhash64("node")).alias("x"),
                                             F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).filter("members > 1")
    return named.groupBy("x", "y", "members").agg(F.min("signature").alias("signature")).select("signature", "members")


def _stars(crowded: DataFrame) -> DataFrame:
    """Distinct pairs of every set with its buckets' centres: the member that meets the most others in all its buckets."""
    met = crowded.groupBy("node").agg(F.sum("members").alias("met"))
    ranked = crowded.join(met, "node").groupBy("signature").agg(F.max(F.struct("met", (-F.col("node")).alias("node"))).alias("centre"))
    return (crowded.join(ranked, "signature").select(F.col("node").alias("one"), (-F.col("centre.node")).alias("two"))
            .filter("one <> two").select(F.greatest("one", "two").alias("a"), F.least("one", "two").alias("b")).distinct())


def _candidates(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct (a, b) pairs across components from (signature, members, node, component, grid) rows.

    A bucket of more than ``BLOCK_ROWS`` rows is cut into blocks by the node's hash, and every two blocks meet in a
    task's bucket of their own, so no bucket outgrows a task.
    """
    blocks = F.ceil(F.col("members") / BLOCK_ROWS).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = (rows.withColumn("blocks", blocks).withColumn("own", own)
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .withColumn("side", F.when(F.col("own") > F.col("other"), 1).otherwise(0))
              .withColumn("bucket", F.xxhash64("signature", F.least("own", "other"), F.greatest("own", "other"))))

    def pairs(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            if table.num_rows:
                name = table.column("bucket").to_numpy()
                others = np.flatnonzero(name != name[-1])
                whole = int(others[-1]) + 1 if len(others) else 0  # the last bucket may go on
                if whole:
                    yield _bucket_pairs(table.slice(0, whole), num, den)
                held = table.slice(whole)
        if held is not None and held.num_rows:
            yield _bucket_pairs(held, num, den)

    return (placed.select("bucket", "side", "node", "component", "grid").repartition("bucket")
            .sortWithinPartitions("bucket").mapInArrow(pairs, "a long, b long").distinct())


def _with_cells(pairs: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """Pairs with the arrays of both ends, as x and y."""
    left = rows.select(F.col("node").alias("a"), F.col(name).alias("x"))
    return pairs.join(left, "a").join(rows.select(F.col("node").alias("b"), F.col(name).alias("y")), "b")


def _bounded(pairs: DataFrame, points: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose sum of coordinate minima admits the similarity."""
    total = F.aggregate("x", F.lit(0), lambda s, v: s + v) + F.aggregate("y", F.lit(0), lambda s, v: s + v)
    bound = F.aggregate(F.zip_with("x", "y", lambda x, y: F.least(x, y)), F.lit(0), lambda s, v: s + v)
    return _with_cells(pairs, points, "counts").filter(den * bound >= num * (total - bound)).select("a", "b").distinct()


def _verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, words: int, seed: int, num: int, den: int) -> DataFrame:
    """The (stored) pairs that reach the similarity on their shingles, which are made for the ends of the pairs alone."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = materialise(ends.join(sets, "node").select("rep.key", "rep.hash", "node"))
    shingles = materialise(_set_rows(docs, wanted, words, seed, False))
    free_shuffles(docs.sparkSession)
    overlap, size = F.size(F.array_intersect("x", "y")), F.size("x") + F.size("y")
    found = materialise(_with_cells(pairs, shingles, "cells").filter(den * overlap >= num * (size - overlap)).select("a", "b").distinct())
    discard(shingles, wanted)
    free_shuffles(docs.sparkSession)
    return found


def _joined_further(joined: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after more links: the components so far are the nodes of a smaller graph."""
    part = joined.select(F.col("node").alias("end"), F.col("component").alias("part"))
    one = links.join(part, F.col("a") == F.col("end"), "left").select(F.coalesce("part", "a").alias("a"), "b")
    edges = one.join(part, F.col("b") == F.col("end"), "left").select("a", F.coalesce("part", "b").alias("b"))
    above = materialise(connected_components(edges).select(F.col("node").alias("part"), F.col("component").alias("top")))
    every = joined.unionByName(links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
                               .join(joined, "node", "left_anti").select("node", F.col("node").alias("component")))
    return every.join(above, F.col("component") == F.col("part"), "left").select("node", F.coalesce("top", "component").alias("component"))


def _grouped(df: DataFrame, key: str, text: str, words: int, num: int, den: int) -> DataFrame:
    """(key, hash, n_shingles, rep) for every row, stored; rep is the least (key, text hash) of its group, null for an empty set or key."""
    docs = df.select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    spark = df.sparkSession
    for seed in range(0, 800, 100):
        keys = materialise(_set_keys(docs, words, seed))
        sets = materialise(keys.filter("key is not null and node is not null").groupBy("node").agg(
            F.min(F.struct("key", "hash")).alias("rep"), F.min("check").alias("low"), F.max("check").alias("high")))
        if not sets.filter("low <> high").limit(1).count():  # else two sets share a number: take other numbers
            break
    docs = docs.filter("key is not null")
    rows = _signature_rows(docs, words, num, den, seed)
    shared = materialise(rows.groupBy("signature").agg(F.min("node").alias("one"), F.max("node").alias("two")).filter("one <> two").select("signature"))
    free_shuffles(spark)
    # What grows with the documents is never sent to all tasks, whatever its size is now: the plan is the same at every size.
    every = materialise(rows.join(shared.hint("merge"), "signature").select("signature", "node").distinct())
    discard(shared)
    free_shuffles(spark)
    buckets = materialise(_distinct_buckets(every))
    crowded = materialise(every.join(buckets, "signature"))
    discard(every, buckets)
    free_shuffles(spark)

    wanted = materialise(crowded.select("node").distinct().join(sets, "node").select("rep.key", "rep.hash", "node"))
    points = materialise(_set_rows(docs, wanted, words, seed, True))
    discard(wanted)
    free_shuffles(spark)
    first = _verified(materialise(_bounded(_stars(crowded), points, num, den)), docs, sets, words, seed, num, den)
    joined = materialise(connected_components(first))
    placed = crowded.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = (placed.groupBy("signature").agg(F.min("component").alias("one"), F.max("component").alias("two"))
             .filter("one <> two").select("signature"))
    rest = placed.join(mixed, "signature").join(points.select("node", "grid"), "node")
    candidates = materialise(_candidates(rest, num, den))
    discard(points, crowded)
    free_shuffles(spark)
    second = _verified(candidates, docs, sets, words, seed, num, den)
    final = materialise(_joined_further(joined, second)) if second.limit(1).count() else joined
    own = sets.select("node", "rep")
    least = final.join(own, "node").groupBy("component").agg(F.min("rep").alias("least"))
    label = materialise(own.join(final.join(least, "component").select("node", "least"), "node", "left")
                        .select("node", F.coalesce("least", "rep").alias("rep")))
    result = materialise(keys.join(label, "node", "left").select(
        "key", "hash", "n_shingles", F.when(F.col("key").isNotNull(), F.col("rep")).alias("rep")))
    discard(keys, sets, label, joined, final, first, second, candidates)
    free_shuffles(spark)
    return result


def similar_documents(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, num: int = 90,
                      den: int = 100) -> DataFrame:
    """One row per row of ``df``: key, n_shingles and component_id, the least key that links reach.

    Words are runs without white space, A-Z lower-cased; a set holds the distinct shingles of ``words`` words, or
    the whole sequence of a shorter text. Two documents link when den * intersection >= num * union. All links
    between different sets are found, except that pairs already joined through other links need not be verified.

    Every distinct set is one node, whatever the keys of its rows are, and buckets with the same members are one. In
    every bucket each set is first held against the one that shares the most buckets with others, the likely original
    of a group of copies; links found so join most of a large group. Only buckets that still hold several components
    go to the R-trees, which form pairs across components alone. So no group is ever expanded into all its pairs.

    The key is a whole number; rows of one key with different texts are documents of their own, which share the key. Null
    keys, and null, empty or blank texts, link with nothing: their component is the key itself. An empty table gives an
    empty one; other columns are ignored.
    """
    found = _grouped(df, key, text, words, num, den)
    return found.select(F.col("key").alias(key), "n_shingles", F.coalesce("rep.key", "key").alias("component_id"))


def drop_similar(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, num: int = 80,
                 den: int = 100) -> DataFrame:
    """One document of every group of linked ones: the one with the least key, and of its texts the least by hash.

    Rows that share a key but not a set of shingles are judged one by one, so unlike texts of one key all stay. Of rows
    with the same key and text one stays. Rows without a key, and texts without words, are in no group and all stay.
    Keys and hashes alone are joined to the documents, so their texts are shuffled only if the list of rows to drop is large.
    """
    found = _grouped(df, key, text, words, num, den).filter("rep is not null")
    name, place = free_name(df, "key"), free_name(df, "hash")
    dropped = materialise(found.filter("key <> rep.key or hash <> rep.hash").select(F.col("key").alias(name), F.col("hash").alias(place)).distinct())
    repeated = materialise(found.filter("key = rep.key and hash = rep.hash").groupBy(F.col("key").alias(name), F.col("hash").alias(place)).count()
                           .filter("count > 1").select(name, place))
    same = lambda table: (df[key].cast("long") == table[name]) & (F.xxhash64(df[text]) == table[place])
    kept = df.join(dropped, same(dropped), "left_anti")
    if not repeated.limit(1).count():
        return kept
    once = df.join(repeated, same(repeated), "left_semi").withColumn(place, F.xxhash64(text)).dropDuplicates([key, place]).drop(place)
    return kept.join(repeated, same(repeated), "left_anti").unionByName(once)
