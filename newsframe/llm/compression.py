"""Quality rules: counts on words and lines, and bands of compression ratios."""

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from newsframe.llm.textbytes import blocks, shingle_hashes, span_hashes, text_bytes, word_spans

CHUNK = 2048
LEVEL = 3
#: (least bytes, lowest ratio, highest ratio) of whole texts; the last row that a text is long enough for holds.
#: Short texts compress badly whatever they say, so their bands are wide, and below 128 bytes there is none.
BANDS = [(0, 0.0, 9.0), (128, 0.33, 1.1), (256, 0.33, 0.95), (512, 0.32, 0.88), (1024, 0.30, 0.80), (2048, 0.28, 0.75), (16384, 0.22, 0.72)]
#: Band of a full chunk, and the share of chunks that may leave it.
CHUNK_BAND = (0.25, 0.75)
CHUNK_SHARE = 0.5
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(mark) for mark in "#*$%&|<>"]] = True


def in_bands(text: bytes, compressor, bands=None, chunk_band=CHUNK_BAND, share: float = CHUNK_SHARE, chunk: int = CHUNK) -> bool:
    """Whether the whole text's ratio lies in the band of its length, and at most ``share`` of its chunks leave theirs.

    Chunks are cut every ``chunk`` bytes; a last one of under half that size is not judged.
    """
    size = len(text)
    _, low, high = [band for band in bands or BANDS if band[0] <= size][-1]
    if size and not low <= len(compressor.compress(text)) / size <= high:
        return False
    chunks = [text[at:at + chunk] for at in range(0, size, chunk) if min(chunk, size - at) >= chunk // 2]
    if size <= chunk:
        return True  # the whole text was its only chunk
    outside = sum(not chunk_band[0] <= len(compressor.compress(part)) / len(part) <= chunk_band[1] for part in chunks)
    return outside <= share * len(chunks)


def _repeated(shingles: np.ndarray, words: int) -> int:
    """How many words lie in windows of three that occur twice or more."""
    if len(shingles) < 2:
        return 0
    order = np.argsort(shingles, kind="stable")
    equal = shingles[order][1:] == shingles[order][:-1]
    twice = np.zeros(len(shingles), bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    covered = np.zeros(words, bool)
    for step in range(3):
        covered[step:step + len(shingles)] |= twice
    return int(covered.sum())


def measure(buffer: np.ndarray, offsets: np.ndarray) -> list[tuple]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, in_bands) of every text."""
    compressor, rows = zstandard.ZstdCompressor(level=LEVEL), []
    for first, last in blocks(offsets):
        low = offsets[first]
        part, at = buffer[low:offsets[last]], offsets[first:last + 1] - low
        starts, ends, running = word_spans(part, at)
        points = np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80)))
        chars = np.concatenate(([0], np.cumsum(points[ends] - points[starts])))
        symbols = np.concatenate(([0], np.cumsum(_SYMBOL[part])))
        windows = shingle_hashes(span_hashes(part, starts, ends), 3)
        # Lines end at a line break or at the text's end; those without a word are left out.
        breaks = np.flatnonzero(part == 0x0A)
        line_starts = np.unique(np.concatenate((at[:-1], breaks + 1)))
        line_starts = line_starts[line_starts < len(part)]
        line_ends = np.minimum(np.append(line_starts[1:], len(part)), len(part))
        line_ends = line_ends - (part[line_ends - 1] == 0x0A) if len(line_ends) else line_ends
        wordy = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
        line_starts, line_ends = line_starts[wordy], line_ends[wordy]
        lines, line_counts = span_hashes(part, line_starts, line_ends), np.searchsorted(line_starts, at)
        for number in range(last - first):
            one, two = running[number], running[number + 1]
            own = lines[line_counts[number]:line_counts[number + 1]]
            rows.append((int(two - one), int(chars[two] - chars[one]), int(symbols[at[number + 1]] - symbols[at[number]]),
                         len(own) - len(np.unique(own)), _repeated(windows[one:max(one, two - 2)], int(two - one)),
                         in_bands(part[at[number]:at[number + 1]].tobytes(), compressor)))
    return rows


def quality_rules(df: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = 50,
                  most_repeated: int = 50) -> DataFrame:
    """One row per document: key, counts, base_failed and kept.

    Words are runs without white space of the whole text. base_failed: under ``least_words`` words, or over
    ``most_repeated`` percent of the words in windows of three words that the text holds twice or more. kept: neither
    that nor a compression ratio outside its band. Null, empty and blank texts have no words and fail; a very long
    text is measured whole; repeated rows get a row each; an empty table stays empty; other columns are ignored.
    """
    rows = df.select(df[key].alias("key"), df[text].alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def judge(batches):
        for batch in batches:
            found = measure(*text_bytes(batch.column("text")))
            counts = [pa.array([row[at] for row in found], pa.int64()) for at in range(5)]
            failed = [row[0] < least_words or 100 * row[4] > most_repeated * row[0] for row in found]
            kept = [row[5] and not bad for row, bad in zip(found, failed, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), *counts, pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_())],
                ["key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])

    return rows.mapInArrow(judge, f"key {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                                  "n_repeat_words long, base_failed boolean, kept boolean").withColumnRenamed("key", key)
