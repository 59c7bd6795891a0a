"""Conversation repair: the cheapest edits that make the roles of a conversation alternate.

A dynamic programme over the rows of a conversation has four states: nothing said yet, after the system row, after a
user row, after an assistant row. Its backward costs are kept only at checkpoints, every square root of the number of
rows; between two checkpoints they are computed again while the walk forward picks, among the edits that keep the cost
least (the tight ones), the one with the least letter.

The blocks between checkpoints are rows of a table. The cost of a block from every state to every state is a 4 x 4
matrix, blocks of many conversations at once; only these matrices, about a square root of the rows of a conversation,
meet in one task, which sets the checkpoints. The walk then runs in all blocks at once, from every state.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from newsframe.session import free_shuffles, materialise

KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
TRUNCATED = 3
WORDLESS = "^[\\x20\\x09-\\x0D]*$"
#: Number of the state after a row with this initial: s, u, a.
STATES = 4
FAR = 1 << 40
_AFTER = np.array([[1, 2, 9, 9], [9, 2, 9, 9], [9, 9, 3, 9], [9, 2, 9, 9]])  # by state and initial (s, u, a, other); 9: not legal
_NEXT = np.array([2, 2, 3, 2])  # the state after an inserted or a reroled row
_END = np.array([0, 6, 3, 0])  # what the rows that are still missing at the end cost


def row_code(initial: Column, unsaid: Column, truncated: Column) -> Column:
    """One number for a row: its initial (s 0, u 1, a 2, other 3), 4 if truncated, 8 if it has to go."""
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return kind + F.when(truncated, 4).otherwise(0) + F.when(unsaid, 8).otherwise(0)


def _before(costs: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Costs before a row from the costs after it; the last axis of ``costs`` is the state, ``code`` has the other ones but it."""
    kind, extra, must = code & 3, np.where(code & 4, TRUNCATED, 0), (code & 8) > 0
    after = _AFTER[:, kind]  # state, rows
    padded = np.concatenate([costs, np.full((*costs.shape[:-1], 6), FAR)], axis=-1)
    shape = (len(code), *(1,) * (costs.ndim - 2))
    best = np.empty_like(costs)
    for state in range(STATES):
        to = np.broadcast_to(after[state].reshape(*shape, 1), (*costs.shape[:-1], 1))
        keep = np.take_along_axis(padded, to, -1)[..., 0] + KEEP + extra.reshape(shape)
        stay = np.where(must.reshape(shape), FAR, np.minimum(keep, costs[..., _NEXT[state]] + REROLE + extra.reshape(shape)))
        best[..., state] = np.minimum(stay, costs[..., state] + DELETE)
    return _with_inserts(np.minimum(best, FAR))


def _with_inserts(costs: np.ndarray) -> np.ndarray:
    """Costs where rows may be inserted first."""
    user, assistant = costs[..., 2], costs[..., 3]
    costs[..., 2], costs[..., 3] = np.minimum(user, assistant + INSERT), np.minimum(assistant, user + INSERT)
    costs[..., 0], costs[..., 1] = (np.minimum(costs[..., at], costs[..., 2] + INSERT) for at in range(2))
    return costs


def block_costs(blocks: list[np.ndarray]) -> np.ndarray:
    """For every block the least cost from each state at its start to each state at its end (blocks, 4, 4)."""
    sizes = np.array([len(one) for one in blocks])
    costs = np.full((len(blocks), STATES, STATES), FAR)
    costs[:, range(STATES), range(STATES)] = 0
    order = np.argsort(-sizes, kind="stable")
    for step in range(1, int(sizes.max(initial=0)) + 1):  # from the last row of every block to its first
        now = order[:np.searchsorted(-sizes[order], -step, "right")]
        code = np.array([blocks[at][-step] for at in now.tolist()])
        # Axes: block, state at the end, state before the row.
        costs[now] = _before(costs[now].swapaxes(1, 2), code).swapaxes(1, 2)
    return costs


def walk(codes: np.ndarray, after: np.ndarray, last: bool) -> tuple[list[str], list[int]]:
    """The ASCII-least tight edits of a block and the state at its end, from each of the four states.

    ``after`` are the backward costs at the block's end, which is a checkpoint. Those inside the block are computed
    again here and dropped with it. The last block also inserts what is missing at the end.
    """
    costs = np.empty((len(codes) + 1, STATES), np.int64)
    costs[-1] = after
    for at in range(len(codes) - 1, -1, -1):
        costs[at] = _before(costs[at + 1][None], codes[at:at + 1])[0]
    table, codes, found, ends = costs.tolist(), codes.tolist(), [], []
    follow, legal = _NEXT.tolist(), _AFTER.tolist()
    for state in range(STATES):
        edits, at = [], 0
        while at < len(codes) or (last and state in (1, 2)):
            if at < len(codes):
                code, here, there = codes[at], table[at], table[at + 1]
                extra = TRUNCATED if code & 4 else 0
                if there[state] + DELETE == here[state]:
                    edits.append("D")
                    at += 1
                    continue
                if here[follow[state]] + INSERT != here[state]:
                    to = legal[state][code & 3]
                    if not code & 8 and to < STATES and there[to] + KEEP + extra == here[state]:
                        edits.append("K")
                    else:
                        edits.append("R")
                        to = follow[state]
                    state, at = to, at + 1
                    continue
            edits.append("I")
            state = follow[state]
        found.append("".join(edits))
        ends.append(state)
    return found, ends


def apply_edits(edits: str, state: int, codes: list[int]) -> tuple[list[list[str]], list[str], list[str]]:
    """For each row of a block: roles inserted before it and its edit; then the roles inserted after the last row."""
    names = {2: "user", 3: "assistant"}
    inserted, row_inserts, row_edits = [], [], []
    for letter in edits:
        if letter == "I":
            state = int(_NEXT[state])
            inserted.append(names[state])
            continue
        row_inserts.append(inserted)
        row_edits.append(letter)
        inserted = []
        if letter == "R":
            state = int(_NEXT[state])
            row_edits[-1] = names[state]
        elif letter == "K":
            state = (codes[len(row_edits) - 1] & 3) + 1
    return row_inserts, row_edits, inserted


def _ordered(rows: DataFrame, parts: list[str]) -> DataFrame:
    """Stored rows with ``seq``, a number that follows the order of ``parts`` over the whole table.

    The rows are cut into ranges of the whole order, so a conversation of any size spreads over many tasks.
    """
    order = [F.col(part).asc_nulls_first() for part in parts]
    return materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("seq", F.monotonically_increasing_id()))


def _same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """The conversation, which may be null, and the other names are equal."""
    on = left["conv"].eqNullSafe(right["conv"])
    for name in names:
        on = on & (left[name] == right[name])
    return on


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows stand in the order of their turn, nulls first; rows of one turn follow the SHA-256 of role and text. A role or
    a text that is null counts as one space; a role is known by its initial, and a row with another initial than s, u, a
    or with an empty role is legal nowhere. Rows without a conversation are one conversation. Equal rows are ordered in
    any way, as they cannot be told apart. An empty table gives an empty one; other columns are ignored.

    No step gathers a conversation: rows are ordered in ranges, first occurrences are minima by content, blocks hold a
    square root of the rows. Only the blocks' matrices, the audit itself and the hash, which by its nature takes one
    byte after the other, belong to one task; the hash reads a sorted stream and holds one row.
    """
    spark = rows.sparkSession
    said, name = F.coalesce(F.col(text), F.lit(" ")), F.coalesce(F.col(role), F.lit(" "))
    plain = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), name.alias("role"), said.alias("text"))
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    full = plain.withColumn("digest", digest)
    closing = F.regexp_extract("text", "[^\\x20\\x09-\\x0D](?=[\\x20\\x09-\\x0D]*\\z)", 0)
    light = full.select("conv", "turn", "digest", F.substring("role", 1, 1).alias("initial"),
                        F.col("text").rlike(WORDLESS).alias("blank"), (~closing.isin(".", "!", "?")).alias("cut"))
    placed = _ordered(light.withColumn("tie", F.monotonically_increasing_id()), ["conv", "turn", "digest", "tie"]).drop("tie")

    # The place of a row in its conversation: its place in the range plus the sizes of the conversation's earlier ranges.
    piece = F.shiftright("seq", 33)  # the number of the range
    placed = placed.withColumn("piece", piece)
    pieces = placed.groupBy("conv", "piece").agg(F.count("*").alias("size"), F.min("seq").alias("head"))
    of = Window.partitionBy("conv")  # as many rows as a conversation has ranges
    pieces = materialise(pieces.select(
        "conv", "piece", "head", F.sum("size").over(of).alias("n"),
        F.coalesce(F.sum("size").over(of.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")))
    first = placed.groupBy("conv", "digest").agg(F.min("seq").alias("seq")).select("seq", F.lit(True).alias("first"))
    marked = placed.join(first, "seq", "left")
    pieces = pieces.withColumnRenamed("conv", "own").withColumnRenamed("piece", "own_piece")
    marked = marked.join(pieces, marked["conv"].eqNullSafe(pieces["own"]) & (marked["piece"] == pieces["own_piece"]))
    blank, again = F.col("blank"), F.col("first").isNull()
    cut = F.col("cut") & ~blank & ~again
    marked = materialise(marked.select(
        "conv", "turn", "seq", "digest", blank.alias("blank"), (~blank & again).alias("duplicate"), cut.alias("truncated"),
        row_code(F.col("initial"), blank | again, cut).alias("code"), (F.col("seq") - F.col("head") + F.col("before")).alias("at"), "n"))
    free_shuffles(spark)

    width = F.ceil(F.sqrt(F.col("n").cast("double"))).cast("long")
    blocks = materialise(
        marked.select("conv", F.floor(F.col("at") / width).alias("block"), "at", "seq", "digest", "code",
                      (F.ceil(F.col("n") / width)).alias("blocks"))
        .groupBy("conv", "block", "blocks").agg(F.array_sort(F.collect_list(F.struct("at", "code", "seq", "digest"))).alias("rows"))
        .select("conv", "block", (F.col("block") == F.col("blocks") - 1).alias("last"),
                F.col("rows.code").alias("codes"), F.col("rows.seq").alias("seqs"), F.col("rows.digest").alias("digests")))
    kind = blocks.schema["conv"].dataType.simpleString()

    def costs(batches):
        for batch in batches:
            codes = [np.asarray(one) for one in batch.column("codes").to_pylist()]
            flat = block_costs(codes).reshape(len(codes), -1)
            pairs = [_illegal(one) for one in codes]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv"), batch.column("block"), pa.array(list(flat), pa.list_(pa.int64())),
                 pa.array([[int(one[0]) & 3, int(one[-1]) & 3, bad] for one, bad in zip(codes, pairs, strict=True)], pa.list_(pa.int64()))],
                ["conv", "block", "costs", "ends"])

    matrices = blocks.select("conv", "block", "codes").mapInArrow(costs, f"conv {kind}, block long, costs array<long>, ends array<long>")
    gathered = matrices.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("block", "costs", "ends"))).alias("rows"))

    def checkpoints(batches):
        for batch in batches:
            for name, found in zip(batch.column("conv"), batch.column("rows").to_pylist(), strict=True):
                after, points = _END.astype(np.int64).copy(), []
                for one in reversed(found):
                    points.append(after.tolist())
                    after = np.minimum((np.array(one["costs"]).reshape(STATES, STATES) + after).min(1), FAR)
                ends = [one["ends"] for one in found]
                bad = sum(end[2] for end in ends) + sum(_bad(one[1], two[0]) for one, two in zip(ends[:-1], ends[1:], strict=True))
                for at in range(0, len(found), 10_000):
                    rows = range(at, min(at + 10_000, len(found)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name.as_py()] * len(rows), batch.column("conv").type), pa.array([found[row]["block"] for row in rows], pa.int64()),
                         pa.array([points[-1 - row] for row in rows], pa.list_(pa.int64())), pa.array([int(after[0])] * len(rows), pa.int64()),
                         pa.array([bad] * len(rows), pa.int64())], ["own", "at", "after", "cost", "illegal"])

    points = materialise(gathered.mapInArrow(checkpoints, f"own {kind}, at long, after array<long>, cost long, illegal long"))

    def edits(batches):
        for batch in batches:
            found = [walk(np.asarray(codes), np.array(after), last) for codes, after, last in zip(
                batch.column("codes").to_pylist(), batch.column("after").to_pylist(), batch.column("last").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv"), batch.column("block"), pa.array([one[0] for one in found], pa.list_(pa.string())),
                 pa.array([one[1] for one in found], pa.list_(pa.int32()))], ["conv", "block", "edits", "ends"])

    walked = materialise(blocks.select("conv", "block", "codes", "last").join(
        points, blocks["conv"].eqNullSafe(points["own"]) & (blocks["block"] == points["at"]))
        .select("conv", "block", "codes", "last", "after").mapInArrow(edits, f"conv {kind}, block long, edits array<string>, ends array<int>"))
    # From block to block only the state passes; it is 0 at the start.
    steps = walked.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("block", "ends"))).alias("steps"))
    states = F.aggregate("steps", F.array(F.lit(0)), lambda found, step: F.concat(
        found, F.array(F.get(step["ends"], F.element_at(found, -1)))))
    starts = steps.select(F.col("conv").alias("own"), F.posexplode(F.slice(states, 1, F.size("steps"))).alias("place", "state"), "steps.block")
    starts = starts.select("own", F.get("block", F.col("place")).alias("at"), "state")
    chosen = materialise(walked.join(starts, walked["conv"].eqNullSafe(starts["own"]) & (walked["block"] == starts["at"]))
                         .select("conv", "block", F.get("edits", F.col("state")).alias("edits"), "state"))
    audits = chosen.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("block", "edits"))).alias("parts")).select(
        "conv", F.array_join("parts.edits", "").alias("audit"))
    free_shuffles(spark)
    counted = marked.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"),
        *[F.count_if(fault).alias(fault) for fault in ("blank", "duplicate", "truncated")])
    totals = points.groupBy("own").agg(F.any_value("cost").alias("cost"), F.any_value("illegal").alias("illegal")).withColumnRenamed("own", "conv")
    hashes = _hashes(blocks, chosen, full, kind)
    result = counted
    for other in (totals, audits, hashes):
        other = other.withColumnRenamed("conv", "own")
        result = result.join(other, result["conv"].eqNullSafe(other["own"]), "left").drop("own")
    empty = hashlib.sha256(b"").hexdigest()
    return result.select(F.col("conv").alias(conv), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                         F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))


def _bad(one: int, two: int) -> int:
    """1 if the initials (s 0, u 1, a 2, other 3) may not be neighbours."""
    return int((one, two) not in ((0, 1), (1, 2), (2, 1)))


def _illegal(codes: np.ndarray) -> int:
    one, two = codes[:-1] & 3, codes[1:] & 3
    return int(len(one) - np.isin(one * 4 + two, (1, 6, 9)).sum())


def _hashes(blocks: DataFrame, chosen: DataFrame, full: DataFrame, kind: str) -> DataFrame:
    """(conv, repaired_sha256) of the repaired rows as ``role:text``, joined by line breaks."""
    def lines(batches):
        for batch in batches:
            names, seqs, digests, before, edit = [], [], [], [], []
            for at, (own, keys, codes, edits, state) in enumerate(zip(*[
                    batch.column(name).to_pylist() for name in ("seqs", "digests", "codes", "edits", "state")], strict=True)):
                inserts, rows, rest = apply_edits(edits, state, codes)
                waiting: list[str] = []
                for seq, digest, new, kept in zip(own, keys, inserts, rows, strict=True):
                    waiting += new
                    if kept != "D":
                        names.append(at)
                        seqs.append(seq)
                        digests.append(digest)
                        before.append(waiting)
                        edit.append(kept)
                        waiting = []
                if waiting + rest:  # rows at the end of the block that have no text of their own
                    names.append(at)
                    seqs.append(own[-1])
                    digests.append(None)
                    before.append(waiting + rest)
                    edit.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv").take(pa.array(names, pa.int64())), pa.array(seqs, pa.int64()), pa.array(digests, pa.string()),
                 pa.array(before, pa.list_(pa.string())), pa.array(edit, pa.string())], ["conv", "seq", "digest", "before", "edit"])

    placed = chosen.withColumnRenamed("conv", "own").withColumnRenamed("block", "at")
    own = blocks.select("conv", "block", "seqs", "digests", "codes")
    schema = f"conv {kind}, seq long, digest string, before array<string>, edit string"
    plan = own.join(placed, own["conv"].eqNullSafe(placed["own"]) & (own["block"] == placed["at"])).select(
        "conv", "seqs", "digests", "codes", "edits", "state").mapInArrow(lines, schema)
    # Of equal rows of a conversation only the first can stay, so the content names the text; copies of it are skipped below.
    texts = full.select(F.col("conv").alias("own"), F.col("digest").alias("content"), "role", "text")
    joined = plan.join(texts, plan["conv"].eqNullSafe(texts["own"]) & (plan["digest"] == texts["content"]), "left").select(
        "conv", "seq", F.when(F.col("edit").isNull(), 1).otherwise(0).alias("tail"), "before",
        F.when(F.col("edit") == "K", F.col("role")).otherwise(F.col("edit")).alias("role"), "text")
    sorted_rows = joined.repartition("conv").sortWithinPartitions("conv", "seq", "tail")

    def digest(batches: Iterator[pa.RecordBatch]):
        name, current, last, some = None, None, None, False
        for batch in batches:
            done: list = []
            for conv, seq, tail, before, role, text in zip(*[batch.column(at).to_pylist() for at in range(6)], strict=True):
                if current is None or conv != name:
                    if current is not None:
                        done.append((name, current.hexdigest()))
                    name, current, last, some = conv, hashlib.sha256(), None, False
                if (seq, tail) == last:
                    continue
                last = (seq, tail)
                for line in [*(f"{one}:" for one in before or []), *([f"{role}:{text}"] if role is not None else [])]:
                    current.update((f"\n{line}" if some else line).encode())
                    some = True
            if done:
                yield _pairs(done, kind_of)
        if current is not None:
            yield _pairs([(name, current.hexdigest())], kind_of)

    kind_of = to_arrow_type(joined.schema["conv"].dataType)
    return sorted_rows.mapInArrow(digest, f"conv {kind}, repaired_sha256 string")


def _pairs(done: list, kind) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([one[0] for one in done], kind), pa.array([one[1] for one in done], pa.string())],
                                      ["conv", "repaired_sha256"])


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows after the damage that the CRC-32 of ``conv:turn`` modulo 20 names (nulls: one space).

    0 drops the row, 1 empties its text, 2 removes the marks ``.!?``, 3 repeats it, 4 makes it the user's.
    """
    space = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(F.col(conv).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn).cast("string"), space))) % 20
    said, name = F.coalesce(F.col(text), space), F.coalesce(F.col(role), space)
    hurt = rows.select(F.col(conv), F.col(turn), F.when(kind == 4, "user").otherwise(name).alias(role),
                       F.when(kind == 1, "").when(kind == 2, F.translate(said, ".!?", "")).otherwise(said).alias(text), kind.alias("__kind"))
    return (hurt.filter("__kind <> 0").withColumn("__copy", F.explode(F.when(F.col("__kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
            .drop("__kind", "__copy"))


def repair_damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``repair`` of the damaged rows, with every conversation that the input has; one without rows left has zeros."""
    found = repair(damaged(rows, conv, turn, role, text), conv, turn, role, text).withColumnRenamed(conv, "__own")
    every = rows.select(conv).distinct()
    counts = [F.coalesce(name, F.lit(0)).cast("long").alias(name) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(found, every[conv].eqNullSafe(found["__own"]), "left").select(
        conv, *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
