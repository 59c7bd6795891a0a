"""Quality classifier: gated attention over the passages of a document (multiple-instance learning)."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from newsframe.llm.common import bounded_sample, free_name
from newsframe.llm.textbytes import blocks, mix, span_hashes, text_bytes, word_spans

PASSAGE_WORDS = 64
SAMPLE_ROWS = 6000
SAMPLE_PASSAGES = 16  # of a sampled text, for the fit alone
LAGS = (1, 2, 3, 5, 8)
#: Character classes of a byte: other, lower-case, upper-case, digit, space, line break, and marks one by one.
CLASSES = np.zeros(256, np.int64)
for _number, _members in enumerate(("", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r",
                                    ".,;:", "!?", "#*$%&", "|<>", "@/\\_~^=+{}[]()", "'\"-`")):
    CLASSES[[ord(letter) for letter in _members]] = _number
CLASSES[128:] = 12
KINDS = 13
FEATURES = KINDS * KINDS + KINDS + len(LAGS) + 2


def encode(buffer: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For every block of texts the feature rows of its passages and the number of passages of each text.

    A passage is a run of ``PASSAGE_WORDS`` words with the bytes between them; its features are the shares of
    character classes and of pairs of neighbouring classes, of words equal to one a few places before, the mean word
    length, and its length against a full passage. A text without words is one passage of zeros.
    """
    for first, last in blocks(offsets):
        low = offsets[first]
        part, at = buffer[low:offsets[last]], offsets[first:last + 1] - low
        starts, ends, running = word_spans(part, at)
        counts = np.diff(running)
        passages = np.maximum(-(-counts // PASSAGE_WORDS), 1)
        base = np.concatenate(([0], np.cumsum(passages)))
        total = int(base[-1])
        owner = np.repeat(np.arange(len(counts)), counts)
        inner = np.arange(len(starts)) - running[:-1][owner]
        passage = base[:-1][owner] + inner // PASSAGE_WORDS
        rows = np.zeros((total, FEATURES), np.float32)
        words = np.bincount(passage, minlength=total).astype(np.float64)
        if len(starts):
            head = np.flatnonzero(np.concatenate(([True], passage[1:] != passage[:-1])))
            edges = np.append(starts[head], len(part))
            place = np.repeat(passage[head], np.diff(edges))  # from a passage's first word up to the next one's
            kinds = CLASSES[part[starts[0]:]]
            size = np.maximum(np.bincount(place, minlength=total), 1)[:, None]
            rows[:, :KINDS] = np.bincount(place * KINDS + kinds, minlength=total * KINDS).reshape(total, KINDS) / size
            pair = (place * KINDS + kinds)[:-1] * KINDS + kinds[1:]
            pair = pair[place[1:] == place[:-1]]
            rows[:, KINDS:KINDS + KINDS ** 2] = np.bincount(pair, minlength=total * KINDS ** 2).reshape(total, -1) / size
            hashes, filled = span_hashes(part, starts, ends), np.maximum(words, 1)
            for column, lag in enumerate(LAGS, KINDS + KINDS ** 2):
                same = (hashes[lag:] == hashes[:-lag]) & (passage[lag:] == passage[:-lag])
                rows[:, column] = np.bincount(passage[lag:][same], minlength=total) / filled
            rows[:, -2] = np.bincount(passage, ends - starts, minlength=total) / filled / 10
            rows[:, -1] = words / PASSAGE_WORDS
        yield rows, passages


class AttentionModel:
    """score = sigmoid(c . sum_k a_k h_k + d) with h = tanh(x W + b) and a = softmax(w . (tanh(h V) * sigmoid(h U)))."""

    def __init__(self, hidden: int = 16, gates: int = 8, seed: int = 3):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float64)
        self.mean, self.scale, self.constant = np.zeros(FEATURES), np.ones(FEATURES), None
        self.weights = {"W": draw(FEATURES, hidden), "b": np.zeros(hidden), "V": draw(hidden, gates), "U": draw(hidden, gates),
                        "w": draw(gates), "c": draw(hidden), "d": np.zeros(1)}

    def _forward(self, rows: np.ndarray, sizes: np.ndarray):
        p, starts = self.weights, np.concatenate(([0], np.cumsum(sizes)[:-1]))
        h = np.tanh(rows @ p["W"] + p["b"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        energy = (v * u) @ p["w"]
        power = np.exp(energy - np.repeat(np.maximum.reduceat(energy, starts), sizes))
        a = power / np.repeat(np.add.reduceat(power, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts)
        return h, v, u, a, z, 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -40, 40))), starts

    def score(self, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        if self.constant is not None or not len(sizes):
            return np.full(len(sizes), self.constant if self.constant is not None else 0.5)
        return self._forward(np.clip((rows - self.mean) / self.scale, -6, 6), sizes)[5]

    def fit(self, documents: list[np.ndarray], labels: np.ndarray, steps: int = 250, batch: int = 600, rate: float = 0.01,
            decay: float = 1e-4, seed: int = 5) -> "AttentionModel":
        """Adam on the cross entropy of the document labels. One class only, or no row: a constant, the share of ones."""
        if len(set(labels.tolist())) < 2:
            self.constant = (float(labels.sum()) + 1) / (len(labels) + 2)
            return self
        everything = np.concatenate(documents)  # the only copy: it is scaled in place
        self.mean, self.scale = everything.mean(0, dtype=np.float64).astype(np.float32), everything.std(0, dtype=np.float64).astype(np.float32) + np.float32(1e-3)
        everything -= self.mean
        everything /= self.scale
        np.clip(everything, -6, 6, out=everything)
        ends = np.cumsum([len(rows) for rows in documents])
        scaled = [everything[end - len(rows):end] for rows, end in zip(documents, ends.tolist(), strict=True)]
        rng, p = np.random.default_rng(seed), self.weights
        first, second = ({name: np.zeros_like(value) for name, value in p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            chosen = rng.permutation(len(scaled))[:batch]
            rows, sizes = np.concatenate([scaled[at] for at in chosen]), np.array([len(scaled[at]) for at in chosen])
            h, v, u, a, z, score, starts = self._forward(rows, sizes)
            error = (score - labels[chosen]) / len(chosen)
            dz = np.repeat(error[:, None] * p["c"], sizes, axis=0)
            da = (h * dz).sum(1)
            de = a * (da - np.repeat(np.add.reduceat(a * da, starts), sizes))
            gate = de[:, None] * p["w"]
            dv, du = gate * u * (1 - v ** 2), gate * v * u * (1 - u)
            dx = (a[:, None] * dz + dv @ p["V"].T + du @ p["U"].T) * (1 - h ** 2)
            slopes = {"W": rows.T @ dx, "b": dx.sum(0), "V": h.T @ dv, "U": h.T @ du, "w": (v * u).T @ de,
                      "c": z.T @ error, "d": error.sum(keepdims=True)}
            pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for name, slope in slopes.items():
                slope = slope + decay * p[name]
                first[name] = 0.9 * first[name] + 0.1 * slope
                second[name] = 0.999 * second[name] + 0.001 * slope ** 2
                p[name] = p[name] - pace * (first[name] / (1 - 0.9 ** step)) / (np.sqrt(second[name] / (1 - 0.999 ** step)) + 1e-8)
        return self


def held_out(key: str):
    """The rows that no label is learned from: crc32 of the key's text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
                sample_rows: int = SAMPLE_ROWS, seed: int = 0,
                sample_passages: int = SAMPLE_PASSAGES) -> AttentionModel:
    """A model fitted on at most ``sample_rows`` labelled rows, the least by a hash of the key, none of them held out.

    Passages are encoded where the texts are; the driver gets the feature rows of at most ``sample_passages`` passages of
    a sampled text, the least by a hash of their place. A key that many documents share gives one text, the least by hash.
    A label that is null, or whose key no document has, is left out.
    """
    known = labels.select(F.col(key).alias("__key"), F.col(label).cast("int").alias("__label")).filter(
        F.col("__label").isin(0, 1) & F.col("__key").isNotNull() & ~held_out("__key"))
    chosen = F.broadcast(bounded_sample(known, F.col("__key"), sample_rows, seed))  # at most sample_rows rows of two numbers

    def passages(batches):
        for batch in batches:
            found = []
            for rows, sizes in encode(*text_bytes(batch.column("text"))):
                for at, size in zip(np.concatenate(([0], np.cumsum(sizes)[:-1])).tolist(), sizes.tolist(), strict=True):
                    places = np.argsort(mix(np.arange(size, dtype=np.uint64), 71))[:sample_passages]
                    found.append(rows[at + np.sort(places)])
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"),
                                              pa.array([rows.tobytes() for rows in found], pa.binary())], ["key", "label", "rows"])

    sample = (docs.join(chosen, F.col(key) == F.col("__key")).groupBy(F.col("__key").cast("string").alias("key"), F.col("__label").alias("label"))
              .agg(F.min_by(F.col(text), F.xxhash64(text)).alias("text")).select("key", "label", F.coalesce("text", F.lit("")).alias("text")))
    rows = sorted(sample.mapInArrow(passages, "key string, label int, rows binary").collect(), key=lambda row: (row["key"], row["label"]))
    given = np.array([row["label"] for row in rows], np.float64)
    features = [np.frombuffer(row["rows"], np.float32).reshape(-1, FEATURES) for row in rows]
    del rows
    return AttentionModel().fit(features, given)


def score_quality(docs: DataFrame, model: AttentionModel, text: str = "text", score: str = "score") -> DataFrame:
    """Adds ``score`` (0 to 1, higher: more likely of quality) from the whole text alone.

    Null, empty and blank texts are one passage without words and get a score like any other; a very long text has as
    many passages as it needs; repeated rows get equal scores; a column that is already named ``score`` is replaced, all
    others pass through untouched.
    """
    columns = docs.columns if score in docs.columns else [*docs.columns, score]
    docs = docs.drop(score) if score != text else docs
    at, name = docs.columns.index(text), free_name(docs, "score")
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    names = schema.names

    def scores(batches):
        for batch in batches:
            found = [model.score(rows, sizes) for rows, sizes in encode(*text_bytes(batch.column(at)))]
            column = pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names)

    return docs.mapInArrow(scores, schema).withColumnRenamed(name, score).select(*columns)


def keep_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.7) -> DataFrame:
    """The documents that score ``least`` or more. Labels that cannot tell the classes apart reject nothing."""
    model = fit_quality(docs, labels, key, text)
    if model.constant is not None:
        return docs
    name = free_name(docs, "quality")
    return score_quality(docs, model, text, name).filter(F.col(name) >= least).drop(name)
