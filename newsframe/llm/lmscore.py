"""Cross-entropy difference of two matched n-gram models over one vocabulary.

``score_against_corpus`` counts all code points in Spark tables; ``matched_models`` and ``score_documents`` are the small models
over 32 symbols that score documents outside the counted ones too.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from newsframe.llm.textbytes import blocks, text_bytes
from newsframe.session import free_shuffles, materialise

ORDER = 4
SYMBOLS = 32
#: The small models' vocabulary: a symbol per letter (A-Z as a-z), and one each for digits, blanks, line breaks, sentence
#: marks, other ASCII marks and all other characters. A symbol stands for one code point; 0 also pads a text's start.
_SYMBOL = np.full(256, 30, np.int32)
_SYMBOL[ord("a"):ord("z") + 1] = np.arange(1, 27)
_SYMBOL[ord("A"):ord("Z") + 1] = np.arange(1, 27)
_SYMBOL[ord("0"):ord("9") + 1] = 27
_SYMBOL[[ord(mark) for mark in " \t"]] = 28
_SYMBOL[[ord(mark) for mark in "\n\r"]] = 0
_SYMBOL[[ord(mark) for mark in ".,;:!?'\"-()"]] = 29
_SYMBOL[128:] = 31
PRIOR = 20.0  # counts that a context borrows from the shorter one


def ngram_cells(buffer: np.ndarray, offsets: np.ndarray, order: int = ORDER):
    """For every block of texts the cell (context and symbol) of each token, and the number of tokens of each text."""
    for first, last in blocks(offsets):
        low = offsets[first]
        part = buffer[low:offsets[last]]
        heads = (part & 0xC0) != 0x80
        running = np.concatenate(([0], np.cumsum(heads)))[offsets[first:last + 1] - low]
        counts = np.diff(running)
        padded = np.zeros(len(counts) * (order - 1) + running[-1], np.int32)
        places = np.arange(running[-1]) + np.repeat(np.arange(1, len(counts) + 1) * (order - 1), counts)
        padded[places] = _SYMBOL[part[heads]]
        cells = np.zeros(len(places), np.int32)
        for back in range(order - 1, -1, -1):
            cells = cells * SYMBOLS + padded[places - back]
        yield cells, counts


def ngram_counts(docs: DataFrame, text: str, target: str, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """How often each of the 32 ** order cells occurs in the target documents, and in all documents.

    Every task adds up its own documents and sends the cells it has seen; what reaches the driver is two numbers per
    cell, for at most 32 ** order cells whatever the corpus.
    """
    def count(batches):
        totals = np.zeros((2, SYMBOLS ** order), np.int64)
        for batch in batches:
            chosen = batch.column(1).fill_null(False).to_numpy(zero_copy_only=False)
            at = 0
            for cells, counts in ngram_cells(*text_bytes(batch.column(0)), order):
                totals[1] += np.bincount(cells, minlength=totals.shape[1])
                mine = np.repeat(chosen[at:at + len(counts)], counts)
                totals[0] += np.bincount(cells[mine], minlength=totals.shape[1])
                at += len(counts)
        seen = np.flatnonzero(totals[1])
        for at in range(0, len(seen), 50_000):
            part = seen[at:at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *[pa.array(total[part]) for total in totals]], ["cell", "own", "n"])

    found = (docs.select(text, target).mapInArrow(count, "cell int, own long, n long").groupBy("cell")
             .agg(F.sum("own").alias("own"), F.sum("n").alias("n"))).toArrow()
    counts = np.zeros((2, SYMBOLS ** order))
    counts[:, found.column("cell").to_numpy()] = found.column("own").to_numpy(), found.column("n").to_numpy()
    return counts[0], counts[1]


def log_probabilities(counts: np.ndarray, order: int = ORDER) -> np.ndarray:
    """log P(symbol | context) per cell; each context is smoothed by the next shorter one, the shortest by even odds."""
    chance = np.full((1, SYMBOLS), 1 / SYMBOLS)
    for size in range(1, order + 1):
        own = counts.reshape(-1, SYMBOLS ** size).sum(0).reshape(-1, SYMBOLS)
        chance = np.tile(chance, (len(own) // len(chance), 1))
        chance = (own + PRIOR * chance) / (own.sum(1, keepdims=True) + PRIOR)
    return np.log(chance).ravel()


def matched_models(docs: DataFrame, target: str, text: str = "text", order: int = ORDER):
    """Log probabilities of the model of the documents that the boolean column ``target`` marks, and of all documents.

    One vocabulary, one order, one smoothing, and equal amounts of counts: the larger table is scaled to the smaller
    one's total, so that smoothing weighs the same in both. Without any target text, or any text, that model is uniform.
    """
    tables = ngram_counts(docs, text, target, order)
    least = min((table.sum() for table in tables if table.sum()), default=1.0)
    return tuple(log_probabilities(table * (least / (table.sum() or 1)), order) for table in tables)


def score_documents(docs: DataFrame, models, text: str = "text", order: int = ORDER) -> DataFrame:
    """Adds n_tokens, target_loss, background_loss (nats per token) and score, their difference (low: like the target).

    Null and empty texts have no tokens, and null losses and score; very long texts are scored whole; repeated rows
    score alike; other columns pass through, and columns named like the results are replaced.
    """
    new = ["n_tokens", "target_loss", "background_loss", "score"]
    kept = [name for name in docs.columns if name not in new]
    source = docs.select(*kept)
    out = StructType([*source.schema.fields, StructField(new[0], LongType()), *[StructField(name, DoubleType()) for name in new[1:]]])
    shared = docs.sparkSession.sparkContext.broadcast([model.astype(np.float32) for model in models])  # 32 ** order numbers each
    names, at = out.names, kept.index(text)

    def score(batches):
        for batch in batches:
            rows: list = [[], [], []]
            for cells, counts in ngram_cells(*text_bytes(batch.column(at)), order):
                owner = np.repeat(np.arange(len(counts)), counts)
                rows[0].append(counts)
                for row, model in zip(rows[1:], shared.value, strict=True):
                    row.append(-np.bincount(owner, model[cells], minlength=len(counts)))
            counts, *sums = [np.concatenate(row) if row else np.zeros(0) for row in rows]
            empty, size = counts == 0, np.maximum(counts, 1)
            losses = [total / size for total in sums]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(counts, pa.int64()),
                 *[pa.array(row, pa.float64(), mask=empty) for row in (*losses, losses[0] - losses[1])]], names)

    return source.mapInArrow(score, out)


#: Below: the models over all code points. A symbol is a code point plus one, 0 pads a text's start.
BITS = 22  # bits of a symbol; two symbols of a 4-gram share a column
GROUP = 4 << 20  # about the bytes of the documents that look up their n-grams together


def code_points(part: np.ndarray) -> np.ndarray:
    """The code points of UTF-8 bytes."""
    at = np.flatnonzero((part & 0xC0) != 0x80)
    found = part[at].astype(np.int32)
    wide = np.flatnonzero(found >= 0x80)
    if len(wide):
        lead, tail = found[wide], np.concatenate((part, np.zeros(3, np.uint8))).astype(np.int32) & 0x3F
        one, two, three = (tail[at[wide] + step] for step in (1, 2, 3))
        found[wide] = np.where(lead < 0xE0, (lead & 0x1F) << 6 | one, np.where(
            lead < 0xF0, (lead & 0x0F) << 12 | one << 6 | two, (lead & 0x07) << 18 | one << 12 | two << 6 | three))
    return found


def code_point_grams(buffer: np.ndarray, offsets: np.ndarray):
    """The symbols of a block of texts, padded, the place of every token's symbol, and the number of tokens of each text."""
    part = buffer[offsets[0]:offsets[-1]]
    running = np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80)))[offsets - offsets[0]]
    counts = np.diff(running)
    symbols = np.zeros(len(counts) * (ORDER - 1) + running[-1], np.int32)
    places = np.arange(running[-1]) + np.repeat(np.arange(1, len(counts) + 1) * (ORDER - 1), counts)
    symbols[places] = code_points(part) + 1
    return symbols, places, counts


def _local(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct symbols in order, and the rank of each symbol number among them."""
    seen = np.zeros(int(symbols.max(initial=0)) + 1, bool)
    seen[symbols] = True
    return np.flatnonzero(seen), np.cumsum(seen) - 1


def _pieces(symbols: np.ndarray, places: np.ndarray):
    """(slice of the places, distinct symbols, ranks, number of the 4-gram at each place): exact numbers below 2 ** 63.

    Only a block with more than 50,000 distinct symbols is cut into several pieces.
    """
    step = len(places)
    if len(_local(symbols)[0]) > 50_000:
        step = 50_000 // ORDER
    for at in range(0, len(places), max(step, 1)):
        part = slice(at, at + step)
        rows = [symbols[places[part] - back] for back in range(ORDER - 1, -1, -1)]
        distinct, rank = _local(symbols if step == len(places) else np.concatenate(rows))
        cells = np.zeros(len(rows[0]), np.int64)
        for row in rows:
            cells = cells * len(distinct) + rank[row]
        yield part, distinct, rank, cells


def _pair_columns(cells: np.ndarray, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first two and the last two symbols of 4-grams from their numbers."""
    row, size = [], len(distinct)
    for _ in range(ORDER):
        row.append(distinct[cells % size])
        cells = cells // size
    return row[3] << BITS | row[2], row[1] << BITS | row[0]


def _grouped(marked: DataFrame, text: str) -> DataFrame:
    """The stored documents with ``__group``, the number of about 4 MB of documents, or of one longer document."""
    source = marked.withColumn("__group", F.lit(0).cast("long"))
    at = source.columns.index(text)

    def number(batches):
        task, count, filled = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            _, offsets = text_bytes(batch.column(at))
            groups = np.zeros(len(offsets) - 1, np.int64)
            for row, size in enumerate(np.diff(offsets).tolist()):
                if filled and filled + size > GROUP:
                    count, filled = count + 1, 0
                filled += size
                groups[row] = task << 32 | count
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(groups)], batch.schema.names)

    return materialise(source.mapInArrow(number, source.schema))


def _group_grams(grouped: DataFrame, text: str, target: str) -> DataFrame:
    """(group, hi, lo, own, n): how often a 4-gram stands in a group's target documents, and in all its documents."""
    def count(batches):
        for batch in batches:
            groups = batch.column(0).to_numpy()
            chosen = batch.column(2).fill_null(False).to_numpy(zero_copy_only=False)
            buffer, offsets = text_bytes(batch.column(1))
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(groups)) + 1, [len(groups)])) if len(groups) else [0]
            for first, last in zip(cuts[:-1], cuts[1:], strict=True):
                symbols, places, counts = code_point_grams(buffer, offsets[first:last + 1])
                mine = np.repeat(chosen[first:last], counts)
                for part, distinct, _, cells in _pieces(symbols, places):
                    found, n = np.unique(cells, return_counts=True)
                    own = np.zeros(len(found), np.int64)
                    target_cells, target_n = np.unique(cells[mine[part]], return_counts=True)
                    own[np.searchsorted(found, target_cells)] = target_n
                    hi, lo = _pair_columns(found, distinct)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(found), groups[first])), pa.array(hi), pa.array(lo), pa.array(own), pa.array(n.astype(np.int64))],
                        ["group", "hi", "lo", "own", "n"])

    return materialise(grouped.select("__group", text, target).mapInArrow(count, "group long, hi long, lo long, own long, n long"))


def gram_losses(grams: DataFrame) -> DataFrame:
    """(hi, lo, target, background): the negative log probability of every 4-gram's last symbol in the two models.

    ``grams`` holds (hi, lo, own, n) counts, in any number of rows per 4-gram. The shared vocabulary is every symbol that
    occurs. Each order's counts are a table of its own, joined to its contexts and to the next shorter order; none is
    sent to the driver or to all tasks. The larger total is scaled to the smaller one.
    """
    mask = (1 << BITS) - 1
    names = ["s1", "s2", "s3", "s4"]
    both = [F.sum("own").alias("own"), F.sum("n").alias("n")]
    table = materialise(grams.groupBy("hi", "lo").agg(*both).select(
        F.shiftright("hi", BITS).alias("s1"), F.col("hi").bitwiseAND(mask).alias("s2"),
        F.shiftright("lo", BITS).alias("s3"), F.col("lo").bitwiseAND(mask).alias("s4"), "own", "n"))
    ones = table.groupBy("s4").agg(*both)
    size, own, n = ones.agg(F.count("*"), F.sum("own"), F.sum("n")).first()
    least = min(filter(None, (own, n)), default=1)
    scale = {"own": least / (own or 1), "n": least / (n or 1)}
    chance = None
    for width in range(1, ORDER + 1):
        keys = names[ORDER - width:]
        rows = table if width == ORDER else table.groupBy(*keys).agg(*both)
        if width == 1:
            rows = rows.withColumns({"own_all": F.lit(own or 0), "n_all": F.lit(n or 0), "p_own": F.lit(1 / max(size, 1)), "p_n": F.lit(1 / max(size, 1))})
        else:
            heads = table.groupBy(*keys[:-1]).agg(F.sum("own").alias("own_all"), F.sum("n").alias("n_all"))
            rows = rows.join(heads.hint("merge"), keys[:-1]).join(chance.hint("merge"), keys[1:])
        chance = rows.select(*keys, *[
            ((F.col(name) * scale[name] + PRIOR * F.col(f"p_{name}")) / (F.col(f"{name}_all") * scale[name] + PRIOR)).alias(f"p_{name}")
            for name in ("own", "n")])
        if width < ORDER:
            chance = materialise(chance)
    return chance.select(F.shiftleft("s1", BITS).bitwiseOR(F.col("s2")).alias("hi"), F.shiftleft("s3", BITS).bitwiseOR(F.col("s4")).alias("lo"),
                         (-F.log("p_own")).alias("target"), (-F.log("p_n")).alias("background"))


def score_against_corpus(docs: DataFrame, target: str, text: str = "text") -> DataFrame:
    """Every document against 4-gram models of the target documents and of all documents, over all their code points.

    Returns the other columns with n_tokens, target_loss, background_loss and score as ``score_documents`` does. The counts are
    Spark tables with a row for every 4-gram that occurs, exact and without a cap, so they grow with the corpus.
    Documents look their 4-grams up in groups of about 4 MB: a 4-gram is joined once per group.
    """
    new = ["n_tokens", "target_loss", "background_loss", "score"]
    grouped = _grouped(docs.drop(*new), text)
    free_shuffles(docs.sparkSession)
    grams = _group_grams(grouped, text, target)
    losses = materialise(gram_losses(grams))
    free_shuffles(docs.sparkSession)
    wanted = materialise(grams.select("group", "hi", "lo").join(losses.hint("merge"), ["hi", "lo"])
                         .select("group", "hi", "lo", F.col("target").cast("float"), F.col("background").cast("float")))
    free_shuffles(docs.sparkSession)
    kept = [name for name in grouped.columns if name not in (text, target, "__group")]
    out = StructType([*grouped.select(*kept).schema.fields, StructField(new[0], LongType()), *[StructField(name, DoubleType()) for name in new[1:]]])

    def score(documents: pa.Table, table: pa.Table) -> pa.Table:
        counts, sums = score_group(documents.column(text), *[table.column(name).to_numpy() for name in ("hi", "lo", "target", "background")])
        empty = counts == 0
        losses = [total / np.maximum(counts, 1) for total in sums]
        results = [pa.array(row, pa.float64(), mask=empty) for row in (*losses, losses[0] - losses[1])]
        return pa.Table.from_arrays([*[documents.column(name) for name in kept], pa.array(counts, pa.int64()), *results], names=out.names)

    return grouped.groupBy("__group").cogroup(wanted.groupBy("group")).applyInArrow(score, out)


def score_group(texts, hi: np.ndarray, lo: np.ndarray, *losses: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Tokens and summed losses of every text of a group, from the losses of the group's 4-grams."""
    buffer, offsets = text_bytes(texts)
    mask, counted, sums = (1 << BITS) - 1, [], [[] for _ in losses]
    table = [hi >> BITS, hi & mask, lo >> BITS, lo & mask]
    for first, last in blocks(offsets):
        symbols, places, counts = code_point_grams(buffer, offsets[first:last + 1])
        owner = np.repeat(np.arange(len(counts)), counts)
        totals = [np.zeros(len(counts)) for _ in losses]
        for part, distinct, rank, cells in _pieces(symbols, places):
            known = np.zeros(len(rank), bool)
            known[distinct] = True
            inside = np.ones(len(hi), bool)
            for row in table:
                inside &= (row < len(rank)) & known[np.minimum(row, len(rank) - 1)]
            numbers = np.zeros(int(inside.sum()), np.int64)
            for row in table:
                numbers = numbers * len(distinct) + rank[row[inside]]
            order = np.argsort(numbers)
            at = order[np.searchsorted(numbers[order], cells)]
            for total, loss in zip(totals, losses, strict=True):
                total += np.bincount(owner[part], loss[inside][at], minlength=len(counts))
        counted.append(counts)
        for row, total in zip(sums, totals, strict=True):
            row.append(total)
    return np.concatenate(counted) if counted else np.zeros(0, np.int64), [np.concatenate(row) if row else np.zeros(0) for row in sums]
