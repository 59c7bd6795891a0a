"""Toxicity: a numpy classifier fitted by non-negative positive-unlabelled risk.

Only confirmed toxic texts and unlabelled texts are learned from. With the class prior p, a loss l and the score f, the
risk is p * E_pos[l(f)] + max(0, E_unl[l(-f)] - p * E_pos[l(-f)]): the second part is the risk of clean texts, written
without any clean example, and may not become negative. Where a batch makes it negative, the step goes back up.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from newsframe.llm.common import bounded_sample, free_name
from newsframe.llm.passages import held_out
from newsframe.llm.textbytes import LOWER, blocks, mix, span_hashes, text_bytes, word_spans

DIMENSIONS = 1 << 20
PREFIXES = (3, 4, 5, 6)
POSITIVE_ROWS, UNLABELLED_ROWS, WORDS_PER_ROW = 4000, 8000, 1500
#: Bytes between words: all ASCII but digits and letters.
BREAKS = np.array([number < 128 and not chr(number).isalnum() for number in range(256)])


def word_features(buffer: np.ndarray, offsets: np.ndarray):
    """Yields, per block of texts, the feature places of all words (one row a word) and the words before each text.

    A word has a place for itself and one for each of its first 3, 4, 5 and 6 bytes, so inflected forms share most.
    """
    for first, last in blocks(offsets):
        low = offsets[first]
        part, at = LOWER[buffer[low:offsets[last]]], offsets[first:last + 1] - low
        starts, ends, running = word_spans(part, at, BREAKS)
        hashes = [span_hashes(part, starts, ends)] + [span_hashes(part, starts, np.minimum(starts + size, ends)) for size in PREFIXES]
        places = np.stack([(mix(row, 41 + number) % np.uint64(DIMENSIONS)).astype(np.int32) for number, row in enumerate(hashes)], axis=1)
        yield places, running


class ToxicityModel:
    """score = sigmoid(bias + the greatest sum of feature weights over the words of the text)."""

    def __init__(self):
        self.weights, self.bias, self.constant = np.zeros(DIMENSIONS, np.float32), 0.0, None

    def _most(self, places: np.ndarray, running: np.ndarray, noise: np.random.Generator | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The greatest word score of every text (0 without words) and the word that has it (-1 without words).

        With ``noise`` the word is drawn from the softmax of twice the scores, so that in a fit all strong words of a text learn.
        """
        sums = self.weights[places].sum(1) if len(places) else np.zeros(0, np.float32)
        drawn = sums if noise is None else sums + noise.gumbel(scale=0.5, size=len(sums)).astype(np.float32)
        filled = np.flatnonzero(np.diff(running) > 0)
        best, word = np.zeros(len(running) - 1), np.full(len(running) - 1, -1)
        if len(filled):
            best[filled] = np.maximum.reduceat(drawn, running[:-1][filled])
            top = np.flatnonzero(drawn == np.repeat(best, np.diff(running)))
            owner = np.searchsorted(running, top, "right") - 1
            word[owner[::-1]] = top[::-1]  # the first of equal ones
            best[filled] = sums[word[filled]]
        return best, word

    def score(self, places: np.ndarray, running: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(running) - 1, self.constant)
        return 1 / (1 + np.exp(-np.clip(self._most(places, running)[0] + self.bias, -40, 40)))

    def fit(self, positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 300, batch: int = 400,
            rate: float = 0.05, decay: float = 1e-3, smooth: float = 5.0, seed: int = 5) -> "ToxicityModel":
        """Adagrad on the non-negative risk with the logistic loss, from weights that compare document frequencies.

        Without positive or without unlabelled texts the score is the prior.
        """
        if not positive or not unlabelled:
            self.constant = float(prior)
            return self
        have = [np.bincount(np.concatenate([np.unique(row) for row in rows]), minlength=DIMENSIONS) for rows in (positive, unlabelled)]
        expected = have[1] * (len(positive) / len(unlabelled))
        self.weights = (np.log((have[0] + smooth) / (expected + smooth)) / (1 + len(PREFIXES))).astype(np.float32)
        self.bias = float(np.log(prior / (1 - prior))) - 1.0
        rng, scale = np.random.default_rng(seed), np.full(DIMENSIONS, 1e-2, np.float32)
        bias_scale = 1e-2

        def pool(rows):
            running = np.concatenate(([0], np.cumsum([len(row) for row in rows])))
            places = np.concatenate(rows) if len(rows) else np.zeros((0, 1 + len(PREFIXES)), np.int32)
            best, word = self._most(places, running, rng)
            return 1 / (1 + np.exp(-np.clip(best + self.bias, -40, 40))), places[np.maximum(word, 0)] if len(places) else np.zeros((len(rows), places.shape[1]), np.int32), word >= 0

        for _ in range(steps):
            p, p_places, p_known = pool([positive[at] for at in rng.integers(0, len(positive), min(batch, len(positive)))])
            u, u_places, u_known = pool([unlabelled[at] for at in rng.integers(0, len(unlabelled), min(batch * 2, len(unlabelled)))])
            clean = np.logaddexp(0, np.log(u / (1 - u) + 1e-30)).mean() - prior * np.logaddexp(0, np.log(p / (1 - p) + 1e-30)).mean()
            # Slopes by score: of l(f) it is s - 1, of l(-f) it is s.
            if clean >= 0:
                p_slope, u_slope = prior * ((p - 1) - p) / len(p), u / len(u)
            else:  # climb back: the slope of the negative part alone, reversed
                p_slope, u_slope = prior * p / len(p), -u / len(u)
            places = np.concatenate([p_places[p_known].ravel(), u_places[u_known].ravel()])
            slopes = np.repeat(np.concatenate([p_slope[p_known], u_slope[u_known]]), 1 + len(PREFIXES))
            touched, where = np.unique(places, return_inverse=True)
            slope = np.bincount(where, slopes).astype(np.float32) + np.float32(decay) * self.weights[touched] / len(u)
            scale[touched] += slope ** 2
            self.weights[touched] -= np.float32(rate) * slope / np.sqrt(scale[touched])
            flat = float(p_slope.sum() + u_slope.sum())
            bias_scale += flat ** 2
            self.bias -= rate * flat / bias_scale ** 0.5
        return self


def fit_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
                 prior: float | None = None, positive_rows: int = POSITIVE_ROWS, unlabelled_rows: int = UNLABELLED_ROWS,
                 words_per_row: int = WORDS_PER_ROW, seed: int = 0) -> ToxicityModel:
    """A model fitted on at most ``positive_rows`` toxic and ``unlabelled_rows`` other texts, none of them held out.

    The rows are those with the least hash of their key; a key that several documents share gives one row of each kind.
    Of a sampled text at most ``words_per_row`` distinct words are used, the least by hash, so the driver gets a bounded
    number of bytes. ``prior`` is the share of toxic texts; by default it is their share among the labels that are not
    held out. Labels that are null, not 0 or 1, or without document, and rows without key, are left out.
    """
    known = labels.select(F.col(key).alias("__key"), F.col(label).cast("int").alias("__label")).filter(
        F.col("__label").isin(0, 1) & F.col("__key").isNotNull() & ~held_out("__key"))
    if prior is None:
        toxic, total = known.agg(F.coalesce(F.sum("__label"), F.lit(0)), F.count("*")).first()
        prior = (toxic + 1) / (total + 2) if total > toxic else 0.5
    chosen = bounded_sample(known.filter("__label = 1").select("__key").distinct(), F.col("__key"), positive_rows, seed).withColumn("__kind", F.lit(1))
    free = docs.select(F.col(key).alias("__key")).filter(F.col("__key").isNotNull() & ~held_out("__key")).distinct()
    other = bounded_sample(free, F.col("__key"), unlabelled_rows, seed + 1).withColumn("__kind", F.lit(0))
    picked = F.broadcast(chosen.unionByName(other))  # at most positive_rows + unlabelled_rows rows of two numbers
    # One text stands for a key that many documents share, the least by hash, chosen before any text reaches the driver.
    rows = (docs.join(picked, F.col(key) == F.col("__key")).groupBy("__kind", "__key")
            .agg(F.min_by(F.col(text), F.xxhash64(text)).alias("text")))

    def features(batches):
        for batch in batches:
            found = []
            for places, running in word_features(*text_bytes(batch.column("text"))):
                for one, two in zip(running[:-1].tolist(), running[1:].tolist(), strict=True):
                    row = np.unique(places[one:two], axis=0)
                    if len(row) > words_per_row:
                        row = row[np.argsort(mix(row[:, 0].astype(np.uint64), 7), kind="stable")[:words_per_row]]
                    found.append(row.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("__kind"), pa.array(found, pa.binary())], ["kind", "rows"])

    kinds = ([], [])
    sample = rows.select("__kind", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(features, "kind int, rows binary")
    for row in sorted(sample.collect(), key=lambda row: (row["kind"], row["rows"])):
        kinds[row["kind"]].append(np.frombuffer(row["rows"], np.int32).reshape(-1, 1 + len(PREFIXES)))
    return ToxicityModel().fit(kinds[1], kinds[0], prior, seed=seed + 5)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", score: str = "score") -> DataFrame:
    """Adds ``score`` (0 to 1, higher: more likely toxic) from the whole text alone.

    Null, empty and wordless texts score as if no word spoke for toxicity; repeated rows score alike; a column that is
    already named ``score`` is replaced, all others pass through untouched.
    """
    columns = docs.columns if score in docs.columns else [*docs.columns, score]
    kept = docs.drop(score) if score != text else docs
    at, name = kept.columns.index(text), free_name(kept, "score")
    schema = StructType([*kept.schema.fields, StructField(name, DoubleType())])
    names = schema.names
    weights, bias, constant = model.weights, model.bias, model.constant

    def scores(batches):
        own = ToxicityModel()
        own.weights, own.bias, own.constant = weights, bias, constant
        for batch in batches:
            found = [own.score(places, running) for places, running in word_features(*text_bytes(batch.column(at)))]
            column = pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names)

    return kept.mapInArrow(scores, schema).withColumnRenamed(name, score).select(*columns)
