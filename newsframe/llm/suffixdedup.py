"""Suffix-array dedup: removes every byte of a long string that also starts earlier in the corpus.

Every window of ``length`` bytes has an anchor, the gram in it with the least hash (the first of equals), which its
bytes alone decide. Equal windows so have equal anchors. Anchors that occur once in the corpus rule their windows
out; the stretches around the others are routed by anchor, and in every shard a suffix array finds the equal windows.
An anchor whose stretches may fill more than a shard is hot: its windows are routed by their own content instead, so
that no task gets them all.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsframe.llm.textbytes import blocks, mix, rolling_hashes, span_hashes, text_bytes
from newsframe.session import materialise

LENGTH = 100
GRAM = 40
SHARD_BYTES = 1 << 21


# --- suffix arrays -------------------------------------------------------------------------------------------------

def first_words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position as one big-endian number, zeros beyond the end."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    words = np.zeros(len(data), np.uint64)
    for at in range(8):
        words = (words << np.uint64(8)) | padded[at:at + len(data)]
    return words


def _group_starts(changes: np.ndarray) -> np.ndarray:
    return np.maximum.accumulate(np.where(changes, np.arange(len(changes)), 0))


def _shared(changes: np.ndarray) -> np.ndarray:
    """Members of groups of more than one."""
    return ~(changes & np.append(changes[1:], True))


def suffix_array(data: np.ndarray, words: np.ndarray | None = None) -> np.ndarray:
    """Positions in the order of their suffixes, by refining ranks (Larsson and Sadakane).

    Suffixes start sorted by eight bytes. A rank is the place where its group begins; each round sorts the members
    of groups that are still larger than one by their own rank and the rank ``h`` bytes further on, and doubles h.
    """
    size = len(data)
    words = first_words(data) if words is None else words
    order = np.argsort(words)
    ordered = words[order]
    changes = np.concatenate(([True], ordered[1:] != ordered[:-1])) if size else np.zeros(0, bool)
    ranks = np.full(size + 1, -1, np.int64)
    ranks[order] = _group_starts(changes)
    places, h = np.flatnonzero(_shared(changes)), 8
    while len(places):
        members = order[places]
        ahead = members + h
        # Eight zero bytes and fewer of them at the very end start in one group: the shorter suffix comes first.
        second = np.where(ahead < size, ranks[np.minimum(ahead, size)] + 1, np.maximum(size - ahead, -8))
        keys = (ranks[members] << 32) + second + 8
        turn = np.argsort(keys)
        members, keys = members[turn], keys[turn]
        order[places] = members
        changes = np.concatenate(([True], keys[1:] != keys[:-1]))
        ranks[members] = places[_group_starts(changes)]
        places, h = places[_shared(changes)], 2 * h
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, words: np.ndarray | None = None) -> np.ndarray:
    """Length of the common prefix of every suffix with the one before it in the order (Kasai and others).

    In text order a suffix shares at least one byte less with its predecessor than the suffix one byte earlier did
    with its own, and exactly one less where the bytes before both are equal; only the others are compared.
    """
    size = len(data)
    words = first_words(data) if words is None else words
    before = np.full(size, -1, np.int64)
    before[order[1:]] = order[:-1]
    here = np.arange(size)
    plain = np.zeros(size, bool)
    inner = (here > 0) & (before > 0)
    plain[inner] = data[here[inner] - 1] == data[before[inner] - 1]
    compared = np.flatnonzero(~plain & (before >= 0))
    reach = np.zeros(size, np.int64)
    one, two, live = compared.copy(), before[compared], np.arange(len(compared))
    while len(live):
        fits = (one < size) & (two < size)
        one, two, live = one[fits], two[fits], live[fits]
        differ = words[one] ^ words[two]
        equal = differ == 0
        bytes_equal = sum((differ < np.uint64(1 << shift)).astype(np.int64) for shift in range(8, 64, 8))
        reach[compared[live]] += np.where(equal, 8, bytes_equal)
        one, two, live = one[equal] + 8, two[equal] + 8, live[equal]
    reach = np.minimum(reach, size - np.maximum(here, np.maximum(before, 0)))
    ends = np.maximum.accumulate(np.where(plain, 0, reach + here)) if size else reach
    return np.maximum(ends - here, 0)[order]


# --- anchors -------------------------------------------------------------------------------------------------------

def _sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while 2 * done <= width:
        values, done = np.minimum(values[:-done], values[done:]), 2 * done
    return np.minimum(values[:len(values) - (width - done)], values[width - done:]) if done < width else values


def anchor_runs(part: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Runs of consecutive windows with the same anchor: anchor hash, text number, first and last window start."""
    none = np.zeros(0, np.int64)
    if len(part) < length:
        return none.astype(np.uint64), none, none, none
    starts = np.arange(len(part) - gram + 1)
    hashes = rolling_hashes(part, starts, starts + gram)
    packed = (hashes & np.uint64(0xFFFFFFFF00000000)) | starts.astype(np.uint64)
    place = (_sliding_minimum(packed, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    steps = np.zeros(len(part) + 1, np.int32)
    long = np.diff(offsets) >= length
    np.add.at(steps, offsets[:-1][long], 1)
    np.add.at(steps, offsets[1:][long] - length + 1, -1)
    whole = np.cumsum(steps)[:len(place)] > 0  # windows inside one text
    begins = whole & np.concatenate(([True], (place[1:] != place[:-1]) | ~whole[:-1]))
    first = np.flatnonzero(begins)
    closes = np.append(begins[1:] | ~whole[1:], True)
    last = np.flatnonzero(whole & closes)
    return hashes[place[first]], np.searchsorted(offsets, first, "right") - 1, first, last


def _spans(buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of many spans one after the other, and their n + 1 offsets."""
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    return buffer[np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])], offsets


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def _anchor_rows(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(anchor, doc, tie, n): how often each text has each of its anchors."""
    for batch in batches:
        buffer, offsets = text_bytes(batch.column("text"))
        doc, tie = (batch.column(name).to_numpy(zero_copy_only=False) for name in ("doc", "tie"))
        for first, last in blocks(offsets):
            low = offsets[first]
            hashes, owner, _, _ = anchor_runs(buffer[low:offsets[last]], offsets[first:last + 1] - low, length, gram)
            turn = np.lexsort((hashes, owner))
            hashes, owner = hashes[turn], owner[turn]
            heads = np.flatnonzero(np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])))) if len(hashes) else np.zeros(0, int)
            counts = np.diff(np.append(heads, len(hashes)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes[heads].view(np.int64)), pa.array(doc[first + owner[heads]]), pa.array(tie[first + owner[heads]]),
                 pa.array(counts.astype(np.int32))], ["anchor", "doc", "tie", "n"])


def _stretches(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """The windows of shared anchors as byte stretches; an equal stretch of an earlier place in the batch is enough.

    A later equal stretch is a repeat as a whole: it goes on without bytes, and to a place of its own text. The stretches
    of hot anchors are cut into their windows, which take the place of stretches and are anchors of their own.
    """
    names = ["route", "anchor", "doc", "tie", "start", "size", "bytes"]
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        texts = [unpack.decompress(one) for one in batch.column("packed").to_pylist()]
        offsets = np.concatenate(([0], np.cumsum([len(text) for text in texts]))).astype(np.int64)
        buffer = np.frombuffer(b"".join(texts), np.uint8)
        doc, tie = (batch.column(name).to_numpy(zero_copy_only=False) for name in ("doc", "tie"))
        keys = _own_keys(batch.column("anchors"))
        hot_keys = _own_keys(batch.column("hot"))
        found: list = []
        for first, last in blocks(offsets):
            low = offsets[first]
            part = buffer[low:offsets[last]]
            hashes, owner, one, two = anchor_runs(part, offsets[first:last + 1] - low, length, gram)
            owner = owner + first
            own = mix(hashes + mix(owner.astype(np.uint64), 41), 43)
            hot = _among(own, hot_keys)
            fits = hot | _among(own, keys)
            hashes, owner, one, size, hot = hashes[fits], owner[fits], one[fits], (two - one + length)[fits], hot[fits]
            found.append((hashes, owner, one + low, size, hot, span_hashes(part, one, one + size)))
        if not found:
            continue
        hashes, owner, one, size, hot, content = (np.concatenate(column) for column in zip(*found, strict=True))
        head = _first_of_equal(mix(hashes + content, 47), doc[owner], tie[owner], one)
        cut = np.flatnonzero(hot & head)
        pieces = [(np.flatnonzero(~(hot & head)), False)] + [(cut[at:at + 2_000], True) for at in range(0, len(cut), 2_000)]
        for chosen, windows in pieces:
            rows = hashes[chosen], owner[chosen], one[chosen], size[chosen], head[chosen]
            if windows:
                rows = _windows(buffer, doc, tie, *rows[:-1], length)
            anchor, text, begin, extent, full = rows
            route = np.where(full, anchor, mix(doc[text].astype(np.int64).view(np.uint64), 53)).view(np.int64)
            place = begin - offsets[text]
            for at in range(0, len(begin), 20_000):
                now = slice(at, at + 20_000)
                data, inner = _spans(buffer, begin[now], np.where(full[now], extent[now], 0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(route[now]), pa.array(anchor[now].view(np.int64)), pa.array(doc[text[now]]), pa.array(tie[text[now]]),
                     pa.array(place[now]), pa.array(extent[now]), _binary(data, inner)], names)


def _own_keys(lists: pa.Array) -> np.ndarray:
    """Hashes of (anchor, text number) from every text's list of anchors, in order."""
    anchors, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    return np.sort(mix(anchors.view(np.uint64) + mix(np.repeat(np.arange(len(lists), dtype=np.uint64), np.diff(ends)), 41), 43))


def _among(own: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return keys[np.minimum(np.searchsorted(keys, own), len(keys) - 1)] == own if len(keys) else np.zeros(len(own), bool)


def _first_of_equal(same: np.ndarray, doc: np.ndarray, tie: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Which rows are the first by text and place of those with the same hash."""
    turn = np.lexsort((one, tie, doc, same))
    head = np.zeros(len(turn), bool)
    head[turn] = np.concatenate(([True], same[turn][1:] != same[turn][:-1])) if len(turn) else False
    return head


def _windows(buffer, doc, tie, hashes, owner, one, size, length: int) -> tuple:
    """Stretches cut into their windows: anchors made of their bytes, text, start, size, and whether it is the first of equal ones.

    Repeats side by side in a stretch are one row.
    """
    data, inner = _spans(buffer, one, size)
    many = size - length + 1
    row = np.repeat(np.arange(len(one)), many)
    shift = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    anchor = mix(rolling_hashes(data, inner[row] + shift, inner[row] + shift + length) + hashes[row], 61)
    start = one[row] + shift
    head = _first_of_equal(anchor, doc[owner[row]], tie[owner[row]], start)
    lead = np.flatnonzero(head | np.concatenate(([True], head[:-1] | (row[1:] != row[:-1]))))
    last = np.append(lead[1:], len(row)) - 1
    return anchor[lead], owner[row[lead]], start[lead], start[last] + length - start[lead], head[lead]


# --- shards --------------------------------------------------------------------------------------------------------

class _Shards:
    """Finds repeated windows in stretches that come in the order of anchor, text and place.

    Whole anchors are gathered into shards of about ``shard_bytes``. An anchor with more bytes than that spans several
    shards: its windows are looked up by binary search in the sorted windows of its earlier shards.
    """

    def __init__(self, length: int, shard_bytes: int):
        self.length, self.limit = length, shard_bytes
        self.held: list[tuple] = []
        self.size = 0
        self.anchor, self.sorted_windows = None, []

    def add(self, data: np.ndarray, offsets: np.ndarray, columns: tuple) -> list[tuple]:
        """Takes rows (anchor, doc, tie, start); gives (doc, tie, start, end) of the repeats that became known."""
        out = []
        first, count = 0, len(offsets) - 1
        while first < count:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + self.limit - self.size, "right")) - 1)
            last = min(last, count)
            self.held.append((data[offsets[first]:offsets[last]].copy(), np.diff(offsets[first:last + 1]), *[c[first:last] for c in columns]))
            self.size += int(offsets[last] - offsets[first])
            first = last
            if self.size >= self.limit or first < count:
                out.append(self._work(final=False))
        return out

    def finish(self) -> list[tuple]:
        return [self._work(final=True)] if self.held else []

    def _work(self, final: bool) -> tuple:
        data, sizes, anchor, doc, tie, start = (np.concatenate(column) for column in zip(*self.held, strict=True))
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        self.held, self.size = [], 0
        cut = len(anchor)
        if not final and anchor[0] != anchor[-1]:
            cut = int(np.flatnonzero(anchor != anchor[-1])[-1]) + 1  # the last anchor may go on: it waits
            self.held = [(data[offsets[cut]:].copy(), sizes[cut:], anchor[cut:], doc[cut:], tie[cut:], start[cut:])]
            self.size = int(offsets[-1] - offsets[cut])
        goes_on = not final and cut == len(anchor)
        row, one, two = self._repeats(data[:offsets[cut]], offsets[:cut + 1], anchor[:cut], goes_on)
        return doc[row], tie[row], start[row] + one, start[row] + two

    def _repeats(self, data: np.ndarray, offsets: np.ndarray, anchor: np.ndarray, goes_on: bool) -> tuple:
        """Row and inner span of repeated bytes in one shard."""
        sizes = np.diff(offsets)
        same = mix(anchor.view(np.uint64) + span_hashes(data, offsets[:-1], offsets[1:]), 59)
        _, head = np.unique(same, return_index=True)  # the first of equal stretches stands for them
        copy = np.ones(len(sizes), bool)
        copy[head] = False
        if self.anchor is not None and anchor[0] != self.anchor:
            self.anchor, self.sorted_windows = None, []
        firsts = np.flatnonzero(~copy)
        number = np.unique(anchor[firsts], return_inverse=True)[1]
        alone = np.bincount(number)[number] == 1  # windows of one stretch differ, as their anchor lies at other places in them
        over = goes_on or self.anchor is not None
        chosen = firsts if over else firsts[~alone]
        found = [(np.flatnonzero(copy), np.zeros(int(copy.sum()), np.int64), sizes[copy])]
        if len(chosen):
            found.append(self._sorted_repeats(data, offsets, chosen, goes_on, anchor))
        return tuple(np.concatenate(column) for column in zip(*found, strict=True))

    def _sorted_repeats(self, data, offsets, chosen, goes_on, anchor) -> tuple:
        sizes = np.diff(offsets)[chosen]
        text, inner = _spans(data, offsets[:-1][chosen], sizes)
        spaced = np.zeros(len(text) + 4 * len(chosen), np.uint8)  # a number of its own closes every stretch
        begin = inner[:-1] + 4 * np.arange(len(chosen))
        spaced[np.arange(len(text)) + np.repeat(4 * np.arange(len(chosen)), sizes)] = text
        marks = np.arange(len(chosen), dtype=">u4").view(np.uint8).reshape(-1, 4)
        spaced[(begin + sizes)[:, None] + np.arange(4)] = marks
        words = first_words(spaced)
        order = suffix_array(spaced, words)
        prefix = common_prefixes(spaced, order, words)
        steps = np.zeros(len(spaced) + 1, np.int32)
        steps[begin] += 1
        np.add.at(steps, begin + sizes - self.length + 1, -1)
        valid = np.cumsum(steps)[:-1] > 0
        group = np.cumsum(prefix < self.length)
        kept = valid[order]
        place, group = order[kept], group[kept]
        repeated = np.zeros(len(spaced), bool)
        if len(place):
            least = np.full(int(group[-1]) + 1, len(spaced), np.int64)
            np.minimum.at(least, group, place)
            repeated[place[place != least[group]]] = True
        if goes_on or self.sorted_windows:
            fresh = place[~repeated[place]]
            fresh = fresh[anchor[chosen][np.searchsorted(begin, fresh, "right") - 1] == (self.anchor if self.sorted_windows else anchor[-1])]
            windows = np.lib.stride_tricks.sliding_window_view(spaced, self.length)[fresh].copy().view(f"S{self.length}").ravel()
            for earlier in self.sorted_windows:  # shards of the same anchor, in their suffixes' order
                at = np.minimum(np.searchsorted(earlier, windows), len(earlier) - 1)
                repeated[fresh[earlier[at] == windows]] = True
            if goes_on:
                self.anchor = anchor[-1]
                self.sorted_windows.append(windows[~repeated[fresh]])
                self.sorted_windows = [shard for shard in self.sorted_windows if len(shard)]
        starts = np.flatnonzero(repeated)
        if not len(starts):
            none = np.zeros(0, np.int64)
            return none, none, none
        row = np.searchsorted(begin, starts, "right") - 1
        cut = np.concatenate(([True], (starts[1:] != starts[:-1] + 1) | (row[1:] != row[:-1])))
        ends = np.append(starts[np.flatnonzero(cut)[1:] - 1], starts[-1])
        row, starts = row[cut], starts[cut]
        return chosen[row], starts - begin[row], ends - begin[row] + self.length


def _shard_spans(batches: Iterator[pa.RecordBatch], length: int, shard_bytes: int) -> Iterator[pa.RecordBatch]:
    shards = _Shards(length, shard_bytes)
    names = ["doc", "tie", "start", "end"]
    for batch in batches:
        column = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in ("anchor", "doc", "tie", "start", "size")}
        _, offsets, data = batch.column("bytes").buffers()
        ends = np.frombuffer(offsets, np.int32)[batch.column("bytes").offset:][:batch.num_rows + 1].astype(np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        done = np.diff(ends) == 0
        out = [(column["doc"][done], column["tie"][done], column["start"][done], (column["start"] + column["size"])[done])]
        if not done.all():
            live = ~done
            starts = ends[:-1][live]
            flat, inner = _spans(data, starts, np.diff(ends)[live])
            out += shards.add(flat, inner, tuple(column[name][live] for name in ("anchor", "doc", "tie", "start")))
        for found in out:
            if len(found[0]):
                yield pa.RecordBatch.from_arrays([pa.array(values.astype(np.int64)) for values in found], names)
    for found in shards.finish():
        if len(found[0]):
            yield pa.RecordBatch.from_arrays([pa.array(values.astype(np.int64)) for values in found], names)


def _cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text without the spans."""
    from hashlib import sha256

    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        rows: list = [[], [], [], []]
        spans = batch.column("spans")
        for packed, own in zip(batch.column("packed"), spans, strict=True):
            text = unpack.decompress(packed.as_py())
            values = own.values
            one, two = (values.field(at).to_numpy(zero_copy_only=False) for at in range(2))
            turn = np.argsort(one, kind="stable")
            one, reach = one[turn], np.maximum.accumulate(two[turn])
            cut = np.concatenate(([True], one[1:] > reach[:-1]))  # spans that touch or overlap are one run
            first, last = one[cut], np.append(reach[:-1][cut[1:]], reach[-1])
            kept = b"".join(text[a:b] for a, b in zip([0, *last.tolist()], [*first.tolist(), len(text)], strict=True))
            for row, value in zip(rows, (len(text) - len(kept), len(first), sha256(kept).hexdigest(), kept), strict=True):
                row.append(value)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc"), batch.column("tie"), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()),
             pa.array(rows[2], pa.string()), pa.array(rows[3], pa.binary())], ["doc", "tie", "removed", "spans", "sha", "kept"])


def _identified(df: DataFrame, key: str, text: str) -> tuple[DataFrame, bool]:
    """(doc, tie, text): the order of the texts, and whether keys repeat. Null keys come first, equal keys go by the text's hash."""
    named = df.select(F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    twice = named.groupBy("doc").count().filter("count > 1").limit(1).count()
    return named.withColumn("tie", F.xxhash64("text") if twice else F.lit(0).cast("long")), bool(twice)


def repeated_bytes(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM,
                   keep_bytes: bool = False, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per row of ``df``: key, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes.

    A byte goes if a string of ``length`` bytes over it also starts earlier: in a text of a smaller key, or earlier
    in the same text. Strings never cross texts and are judged on the input. n_spans counts maximal removed runs.

    Null texts are empty; shorter texts than ``length`` keep all. Null keys come before all others; of equal keys
    the text with the smaller hash comes first, and rows equal in key and text are one text. Very long texts are
    hashed whole in one task. An empty table gives an empty one; other columns are ignored.
    """
    docs, twice = _identified(df, key, text)
    rows = docs.filter(F.octet_length("text") >= length)
    if twice:
        rows = rows.dropDuplicates(["doc", "tie"])
    anchors = rows.mapInArrow(lambda batches: _anchor_rows(batches, length, gram), "anchor long, doc long, tie long, n int")
    most = shard_bytes // (2 * length - gram)
    shared = materialise(anchors.groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1")
                         .select("anchor", (F.col("n") > most).alias("many")))
    suspects = (anchors.join(shared, "anchor").groupBy("doc", "tie")
                .agg(F.collect_list(F.expr("if(many, null, anchor)")).alias("anchors"), F.collect_list(F.expr("if(many, anchor, null)")).alias("hot")))

    def pack(batches):
        for batch in batches:
            press = zstandard.ZstdCompressor(level=3)
            buffer, offsets = text_bytes(batch.column("text"))
            view = memoryview(buffer)
            packed = [press.compress(view[one:two]) for one, two in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("tie"), pa.array(packed, pa.binary())], ["doc", "tie", "packed"])

    packed = rows.select("doc", "tie", "text").mapInArrow(pack, "doc long, tie long, packed binary").join(suspects, ["doc", "tie"])
    packed = materialise(packed)
    stretches = packed.mapInArrow(lambda batches: _stretches(batches, length, gram),
                                  "route long, anchor long, doc long, tie long, start long, size long, bytes binary")
    found = (stretches.repartition("route").sortWithinPartitions("anchor", "doc", "tie", "start")
             .mapInArrow(lambda batches: _shard_spans(batches, length, shard_bytes), "doc long, tie long, start long, end long"))
    spans = found.groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    cut = packed.select("doc", "tie", "packed").join(spans, ["doc", "tie"]).mapInArrow(
        _cut_texts, "doc long, tie long, removed long, spans long, sha string, kept binary")
    cut = materialise(cut if keep_bytes else cut.drop("kept"))
    whole = docs.select("doc", "tie", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("all_sha"),
                        *([F.encode("text", "UTF-8").alias("all_bytes")] if keep_bytes else []))
    return whole.join(cut, ["doc", "tie"], "left").select(
        F.when(F.col("doc") != -(1 << 63), F.col("doc")).alias(key), "n_bytes", F.coalesce("removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("sha", "all_sha").alias("kept_sha256"),
        *([F.coalesce("kept", "all_bytes").alias("kept")] if keep_bytes else []))
