"""Features: word counts, TF-IDF, padded sequences, embedding rows, cluster terms.

The relational form ``(key, word, n)`` and the vector form both hold every term of the training set. No list of terms
ever is on the driver: terms are numbered in a table, and documents look their terms up there.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, StringType, StructField, StructType

from newsframe.operators.frequency import occurrences, top
from newsframe.operators.joins import lookup_join
from newsframe.operators.ordering import range_index
from newsframe.operators.vocabulary import vocabulary
from newsframe.session import materialise


def count_rows(df: DataFrame, key: str, words: str, by: list[str] | None = None,
               vocabulary_words: DataFrame | None = None) -> DataFrame:
    """(key, by..., word, n); only words of the vocabulary if one is given.

    Whole documents are moved to the partition of their key before they are cut into words. That is one shuffle of
    the texts; the counts, and later sums per document, then need no shuffle of the far larger word rows.
    """
    placed = df.select(key, *(by or []), F.col(words).alias("_words")).repartition(key)
    rows = occurrences(placed, "_words", key, *(by or [])).groupBy(key, *(by or []), "word").agg(F.count("*").alias("n"))
    return rows if vocabulary_words is None else lookup_join(rows, vocabulary_words.select("word"), "word")


def corpus_tfidf(rows: DataFrame, occurrences: DataFrame, documents: DataFrame, key: str,
                 exact_idf: bool = False) -> DataFrame:
    """TF-IDF per set from (key, set, word, n), (set, word, n_t) and (set, n).

    ``(ln(n) + 1) * idf`` with ``idf = ln(documents / n_t)``, where n_t counts all occurrences in the set. Count
    vectors hold whole numbers, so the logarithm and the product are both cut off towards zero unless
    ``exact_idf``.
    """
    # One row per set: small by nature, the sets are numbered 0, 1, 2.
    sizes = F.broadcast(documents.withColumnRenamed("n", "_documents"))
    idf = F.log(F.col("_documents") / F.col("n_t"))
    table = occurrences.join(sizes, "set").select("set", "word", (idf if exact_idf else idf.cast("int")).alias("_idf"))
    value = (F.log("n") + 1) * F.col("_idf")
    return lookup_join(rows, table, ["set", "word"]).select(
        key, "set", "word", (value if exact_idf else value.cast("int")).alias("tfidf"))


WORDS = 500_000  # words of the documents of a block
PARTS = 48  # parts of the terms; of many blocks there is one for every four, which has room for as many terms as those have


def _in_order(docs: pa.Table) -> pa.Table:
    """Rows of a block in an order that is the same in every pass."""
    return docs.sort_by([("_key", "ascending"), ("_tie", "ascending")])


def _terms(docs: pa.Table, low: int, high: int) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Row and term of every run of ``low`` to ``high`` neighbouring words; runs over a missing word go.

    The words are numbered in their order and a run is the number of its beginning and that of its last word, so only the text of
    different runs is put together. Terms of one length are sorted by their words, whatever the order of the rows.
    """
    lists = docs.column("_words").combine_chunks()
    words = lists.flatten().dictionary_encode()
    owner = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    order = pc.array_sort_indices(words.dictionary).to_numpy()
    size, names = max(len(order), 1), words.dictionary.take(pa.array(order)).cast(pa.string())
    rank = np.empty(len(order) + 1, np.int64)
    rank[order], rank[-1] = np.arange(len(order)), -1
    code = rank[pc.fill_null(words.indices, len(order)).to_numpy(zero_copy_only=False)]
    run, texts, owners, found, listed = code, names, [], [], []  # the run that begins at every word, -1 where there is none
    for n in range(1, high + 1):
        if n > 1:
            start = np.flatnonzero((run[:len(run) - 1] >= 0) & (owner[:len(owner) - n + 1] == owner[n - 1:]) & (code[n - 1:] >= 0)) if len(owner) >= n else np.zeros(0, np.int64)
            pairs, at = np.unique(run[start] * size + code[start + n - 1], return_inverse=True)
            run = np.full(max(len(owner) - n + 1, 0), -1, np.int64)
            run[start] = at
            texts = pc.binary_join_element_wise(texts.take(pa.array(pairs // size)), names.take(pa.array(pairs % size)), " ")
        if n >= low:
            start = np.flatnonzero(run >= 0)
            owners.append(owner[start])
            found.append(run[start] + sum(map(len, listed)))
            listed.append(texts)
    at, terms = np.concatenate(found), pa.concat_arrays(listed)
    if high > 1 and pc.any(pc.match_substring(names, " ")).as_py():  # two runs may read alike
        alike = terms.dictionary_encode()
        at, terms = alike.indices.to_numpy()[at], alike.dictionary
    return np.concatenate(owners), pa.DictionaryArray.from_arrays(pa.array(at, pa.int64()), terms)


def _counted(docs: pa.Table, low: int, high: int) -> tuple[pa.StringArray, np.ndarray]:
    """The different terms of a block, and how many of its documents with ``_train`` hold each."""
    docs = _in_order(docs)
    owner, terms = _terms(docs, low, high)
    size = len(terms.dictionary)
    document = docs.column("_key").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    inside = docs.column("_train").to_numpy()[owner]
    pairs = np.unique(document[owner[inside]].astype(np.int64) * max(size, 1) + terms.indices.to_numpy()[inside])
    return terms.dictionary, np.bincount(pairs % max(size, 1), minlength=size).astype(np.int32)


def _dealt(terms: pa.StringArray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the terms part by part, and where every part begins; a term's hash gives its part."""
    part = (pd.util.hash_array(terms.to_numpy(zero_copy_only=False), categorize=False) % np.uint64(parts)).astype(np.int32)
    return np.argsort(part, kind="stable"), np.append(0, np.cumsum(np.bincount(part, minlength=parts)))


def _packed(numbers) -> bytes:
    return pa.compress(numbers, codec="zstd", asbytes=True)


def _unpacked(packet: bytes, count: int, kind=np.int32) -> np.ndarray:
    return np.frombuffer(pa.decompress(packet, count * np.dtype(kind).itemsize, codec="zstd"), kind)


@dataclass
class Blocks:
    """Documents dealt by their key into blocks of about ``WORDS`` words; rows with one key are one document.

    A term is looked up once for a block and not once for each of its documents: what is shuffled by word are the different
    terms of the blocks, and their places come back as numbers. The texts themselves are only moved to their block.
    """
    rows: DataFrame
    size: int
    key: str
    columns: list[str]
    low: int
    high: int

    def terms(self, train: str = "false") -> DataFrame:
        """(_block, place, word, documents): the different terms of every block and how many documents with ``train`` hold them."""
        low, high = self.low, self.high

        def listed(docs: pa.Table) -> pa.Table:
            terms, documents = _counted(docs, low, high)
            size = len(terms)
            return pa.table({"_block": pa.array(np.repeat(docs.column("_block")[0].as_py(), size).astype(np.int32)),
                             "place": pa.array(np.arange(size, dtype=np.int32)), "word": terms, "documents": pa.array(documents)})

        return self._with_train(train).groupBy("_block").applyInArrow(listed, "_block int, place int, word string, documents int")

    def _with_train(self, train: str) -> DataFrame:
        inside = F.coalesce(F.expr(train), F.lit(False))
        return self.rows.select("_block", F.col(self.key).alias("_key"), "_tie", "_words", inside.alias("_train"))

    def parts(self) -> int:
        return max(min(self.size, PARTS), -(-self.size // 4))

    def frequencies(self, train: str) -> DataFrame:
        """(_block, part, n, documents): how many documents with ``train`` hold each term of a block, over all blocks.

        A block sends its terms in as many packets as there are parts, a term's hash giving its part, and a part sends the sums back in the
        order of the packet. So a term needs neither a row nor its place, and lies compressed among its neighbours of the alphabet.
        """
        low, high = self.low, self.high
        parts = self.parts()

        def sent(docs: pa.Table) -> pa.Table:
            terms, documents = _counted(docs, low, high)
            order, ends = _dealt(terms, parts)
            terms, documents, rows = terms.take(pa.array(order)), documents[order], []
            sizes = pc.binary_length(terms).to_numpy()
            data, begins = terms.buffers()[2] or pa.py_buffer(b""), np.append(0, np.cumsum(sizes, dtype=np.int64))
            for part in np.flatnonzero(np.diff(ends)):
                one, two = ends[part], ends[part + 1]
                text = data.slice(begins[one], begins[two] - begins[one])
                rows.append([int(part), int(two - one), text.size, _packed(text), _packed(sizes[one:two].tobytes()), _packed(documents[one:two].tobytes())])
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            return pa.table([pa.array(np.full(len(rows), docs.column("_block")[0].as_py(), np.int32)),
                             *[pa.array(column, kind) for column, kind in zip(columns, (pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 3), strict=True)]],
                            ["_block", "part", "n", "size", "words", "sizes", "documents"])

        def added(packets: pa.Table) -> pa.Table:
            words, documents = [], []
            columns = [packets.column(name).to_pylist() for name in ("n", "size", "words", "sizes", "documents")]
            for n, size, text, sizes, own in zip(*columns, strict=True):
                ends = np.append(0, np.cumsum(_unpacked(sizes, n))).astype(np.int32)
                words.append(pa.StringArray.from_buffers(n, pa.py_buffer(ends.tobytes()), pa.decompress(text, size, codec="zstd")))
                documents.append(_unpacked(own, n))
            same = pa.concat_arrays(words).dictionary_encode()
            at = same.indices.to_numpy()
            sums = np.zeros(len(same.dictionary), np.int64)
            np.add.at(sums, at, np.concatenate(documents))
            sums = np.split(sums[at], np.cumsum(columns[0])[:-1])
            return pa.table([packets.column("_block"), packets.column("part"), packets.column("n"), pa.array([_packed(own.tobytes()) for own in sums], pa.binary())],
                            ["_block", "part", "n", "documents"])

        schema = "_block int, part int, n int, size long, words binary, sizes binary, documents binary"
        packets = self._with_train(train).groupBy("_block").applyInArrow(sent, schema).repartition(parts, "part")
        return packets.groupBy("part").applyInArrow(added, "_block int, part int, n int, documents binary")

    def _weighed(self, table: DataFrame, unit: bool, schema: StructType, output) -> DataFrame:
        """``output(documents, document of every row, number of documents, cells)`` for every block.

        ``table`` is (_block, place, index, weight), or what ``smooth_idf`` gives.
        """
        low, high, parts = self.low, self.high, self.parts()
        whole = "total" in table.columns

        def weighed(docs: pa.Table, known: pa.Table) -> pa.Table:
            docs = _in_order(docs)
            owner, terms = _terms(docs, low, high)
            keys = docs.column("_key").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            if whole:
                documents, known = np.zeros(len(terms.dictionary), np.int64), known.sort_by("part")
                packets = [_unpacked(own, n, np.int64) for own, n in zip(known.column("documents").to_pylist(), known.column("n").to_pylist(), strict=True)]
                documents[_dealt(terms.dictionary, parts)[0]] = np.concatenate([np.zeros(0, np.int64), *packets])
                places = index = np.flatnonzero(documents)
                weights = np.log((1.0 + (known.column("total")[0].as_py() if len(places) else 0)) / (1 + documents[places])) + 1
            else:
                known = known.sort_by("index")
                places, index, weights = (known.column(name).to_numpy() for name in ("place", "index", "weight"))
            size, number = max(len(places), 1), int(keys.max()) + 1
            rank = np.full(len(terms.dictionary), -1, np.int64)
            rank[places] = np.arange(len(places))
            at = rank[terms.indices.to_numpy()]
            pairs, counts = np.unique(keys[owner[at >= 0]].astype(np.int64) * size + at[at >= 0], return_counts=True)
            document, at = pairs // size, pairs % size
            value = counts * weights[at]
            if unit:
                value = value / np.sqrt(np.bincount(document, value * value, minlength=number))[document]
            return output(docs, keys, number, document, index[at], value, lambda: terms.dictionary.take(pa.array(places[at])))

        rows = self.rows.select("_block", F.col(self.key).alias("_key"), "_tie", "_words", *[F.col(name).alias(f"_own_{name}") for name in self.columns])
        if not whole:
            table = table.select("_block", "place", F.col("index").cast("long").alias("index"), F.col("weight").cast("double").alias("weight"))
        return rows.groupBy("_block").cogroup(table.repartition(self.size, "_block").groupBy("_block")).applyInArrow(weighed, schema)

    def _key_type(self):
        return self.rows.schema[self.key].dataType

    def entries(self, table: DataFrame, unit: bool) -> DataFrame:
        """(key, index, value): a row for every term of a document in the table (_block, place, index, weight)."""
        def cells(docs, keys, number, document, index, value, words):
            return pa.table([_first(docs, keys).take(pa.array(document)), pa.array(index.astype(np.int32)), pa.array(value)], names)

        names = [self.key, "index", "value"]
        return self._weighed(table, unit, StructType([StructField(self.key, self._key_type()), StructField("index", IntegerType()),
                                                      StructField("value", DoubleType())]), cells)

    def worded(self, table: DataFrame, unit: bool, word: str | None, value: str) -> DataFrame:
        """(key, word, value): the same with the term itself, which is left out if no name is given for it."""
        def cells(docs, keys, number, document, index, values, words):
            return pa.table([_first(docs, keys).take(pa.array(document)), *([words().cast(pa.string())] if word else []), pa.array(values)], names)

        names = [self.key, *([word] if word else []), value]
        return self._weighed(table, unit, StructType([StructField(self.key, self._key_type()), *([StructField(word, StringType())] if word else []),
                                                      StructField(value, DoubleType())]), cells)

    def arrays(self, table: DataFrame, unit: bool) -> DataFrame:
        """(key, columns..., indices, values): one row for every row, empty without a known term or without a key."""
        def lists(docs, keys, number, document, index, value, words):
            ends = np.append(np.searchsorted(document, np.arange(number + 1)), len(document)).astype(np.int32)  # the last one is empty
            own = docs.column("_key").combine_chunks()
            rows = pa.array(np.where(pc.is_valid(own).to_numpy(zero_copy_only=False), keys, number))
            found = [pa.ListArray.from_arrays(pa.array(ends), pa.array(part)).take(rows) for part in (index.astype(np.int32), value)]
            return pa.table([own, *[docs.column(f"_own_{name}") for name in columns], *found], [key, *columns, "indices", "values"])

        key, columns = self.key, self.columns
        return self._weighed(table, unit, StructType([
            StructField(key, self._key_type()), *[self.rows.schema[name] for name in columns],
            StructField("indices", ArrayType(IntegerType())), StructField("values", ArrayType(DoubleType()))]), lists)


def _first(docs: pa.Table, keys: np.ndarray) -> pa.Array:
    """The key of every document of a block."""
    return docs.column("_key").combine_chunks().take(pa.array(np.unique(keys, return_index=True)[1]))


def in_blocks(df: DataFrame, key: str, words: str, columns: list[str] | None = None, ngrams: tuple[int, int] = (1, 1)) -> Blocks:
    """The documents in as many blocks as their words need; terms are runs of ``ngrams[0]`` to ``ngrams[1]`` words."""
    total = df.agg(F.sum(F.size(words))).first()[0] or 0
    size = max(1, -(-total // WORDS))
    own = [name for name in columns or [] if name != key]
    rows = df.select(key, *own, F.col(words).alias("_words"), F.xxhash64(words).alias("_tie"),
                     F.pmod(F.xxhash64(key), F.lit(size)).cast("int").alias("_block"))
    return Blocks(rows.repartition(size, "_block"), size, key, own, *ngrams)


def smooth_idf(blocks: Blocks, train: str, documents: int) -> DataFrame:
    """(_block, part, n, documents, total): what ``idf = ln((1 + documents) / (1 + df)) + 1`` of the terms of the rows with ``train`` is made of.

    The numbers of documents of a block's terms lie in packets (see ``Blocks.frequencies``).
    """
    return blocks.frequencies(train).withColumn("total", F.lit(documents))


def vectoriser_tfidf(blocks: Blocks, idf: DataFrame, word: str | None = "word") -> DataFrame:
    """(key, word, tfidf): counts times idf over the length of the vector of the document; unknown words go.

    Without a name for the words the column is left out.
    """
    return blocks.worded(idf, True, word, "tfidf")


@dataclass
class Vectoriser:
    """Terms of a training set: (word, index, weight), the number of terms, and whether vectors get length 1."""
    terms: DataFrame
    size: int
    unit: bool

    def _known(self, blocks: Blocks) -> DataFrame:
        return blocks.terms().join(self.terms, "word").select("_block", "place", "index", "weight")

    def entries(self, df: DataFrame, key: str, words: str) -> DataFrame:
        """(key, index, value): the cells of the vectors that are not zero; unknown terms go."""
        blocks = in_blocks(df, key, words)
        return blocks.entries(self._known(blocks), self.unit)

    def vectors(self, df: DataFrame, key: str, words: str, columns: list[str] | None = None) -> DataFrame:
        """(key, columns..., features): one sparse vector per row, empty where no term is known, as a stored table.

        The vectors are built as plain arrays and read back under the vector type, which is stored alike.
        """
        blocks = in_blocks(df, key, words, columns)
        rows = blocks.arrays(self._known(blocks), self.unit)
        vector = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(self.size).alias("size"), "indices", "values")
        rows = rows.select(key, *(columns or []), vector.alias("features"))
        return materialise(rows, StructType([*rows.schema.fields[:-1], StructField("features", VectorUDT())]))


def term_table(train: DataFrame, words: str, kept: DataFrame | None = None) -> DataFrame:
    """(word, documents, index): every term of the training set, numbered from 0 in alphabetical order.

    ``kept`` (word) restricts the terms, for models that cannot take all, for instance to a ``frequency_band``.
    """
    terms = (occurrences(train, F.array_distinct(F.col(words))).groupBy("word").agg(F.count("*").alias("documents")))
    if kept is not None:
        terms = terms.join(kept.select("word"), "word", "left_semi")
    return range_index(terms, ["word"], "index").withColumn("index", F.col("index").cast("int"))


def count_vectoriser(train: DataFrame, words: str, kept: DataFrame | None = None) -> Vectoriser:
    """Bag of words over all terms of the training set."""
    terms = materialise(term_table(train, words, kept).select("word", "index", F.lit(1.0).alias("weight")))
    return Vectoriser(terms, terms.count(), False)


def tfidf_vectoriser(train: DataFrame, words: str, kept: DataFrame | None = None) -> Vectoriser:
    """Counts times ``ln((1 + n) / (1 + documents)) + 1``, scaled to length 1; n-grams come in as the word list."""
    weight = F.log(F.lit(1.0 + train.count()) / (1 + F.col("documents"))) + 1
    terms = materialise(term_table(train, words, kept).select("word", "index", weight.alias("weight")))
    return Vectoriser(terms, terms.count(), True)


def sequence_index(train: DataFrame, words: str, numwords: int | None = 10000, oov: bool = True) -> DataFrame:
    """(word, index): words by falling frequency. With ``oov`` index 1 is kept for unknown words.

    Only indexes below ``numwords`` are kept, all without it.
    """
    first = 2 if oov else 1
    best = top(vocabulary(train, words), None if numwords is None else max(numwords - first, 0), "word", rank="rank")
    return best.select("word", (F.col("rank") + (first - 1)).cast("int").alias("index"))


def padded_sequences(df: DataFrame, key: str, words: str, index: DataFrame, maxlen: int = 1000, oov: bool = True,
                     keep_first: bool = True) -> DataFrame:
    """(key, sequence): word indexes, cut to ``maxlen`` at the end (or the front) and padded with 0 at the front.

    Unknown words become 1, or are dropped without ``oov``. Documents are moved to the partition of their key once,
    before they are cut into words; as long as the index is small enough to be sent to them, nothing else is shuffled.
    No more than ``maxlen`` words of a document are gathered.
    """
    listed = F.col(words)
    if oov:  # every word keeps its place, so the cut can come before the look-up
        listed = F.slice(listed, 1, maxlen) if keep_first else F.slice(
            listed, F.greatest(F.size(listed) - maxlen + 1, F.lit(1)), F.lit(maxlen))
    placed = df.select(key, listed.alias("_words")).repartition(key).select(key, F.posexplode_outer("_words").alias("_at", "word"))
    rows = lookup_join(placed, index, "word", how="left")
    rows = rows.withColumn("index", F.coalesce("index", F.when(F.col("word").isNotNull(), F.lit(1)))) if oov else rows
    known = F.col("index").isNotNull()
    order = F.col("_at") if keep_first else F.desc("_at")
    rows = rows.withColumn("_turn", F.row_number().over(Window.partitionBy(key).orderBy(F.when(known, 0).otherwise(1), order)))
    pair = F.when(known & (F.col("_turn") <= maxlen), F.struct("_at", "index"))
    rows = rows.groupBy(key).agg(F.array_sort(F.collect_list(pair)).alias("_pairs"))
    return rows.select(key, F.concat(F.array_repeat(F.lit(0), maxlen - F.size("_pairs")), F.col("_pairs.index")).alias("sequence"))


def embedding_rows(index: DataFrame, vectors: DataFrame, dimensions: int) -> DataFrame:
    """(word, index, vec): the pretrained vector of every indexed word, zeros for unknown ones."""
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dimensions)
    return index.join(vectors, "word", "left").select("word", "index", F.coalesce("vec", zeros).alias("vec"))


SEQUENCES = 1000  # sequences of a block whose vectors are put together


def embedded_sequences(sequences: DataFrame, key: str, rows: DataFrame, dimensions: int, output: str = "features") -> DataFrame:
    """The rows with ``features``: the vectors of their padded sequence one after the other, zeros for numbers without one.

    Sequences are dealt by their key into blocks, which look every number up once; the vectors are put together there, a block at a
    time. ``sequences`` is read twice and should be a stored table; a fit needs only its numbers (see ``plans.embedded``).
    """
    size = max(1, -(-sequences.count() // SEQUENCES))
    placed = sequences.filter(F.col("sequence").isNotNull()).withColumn("_block", F.pmod(F.xxhash64(key), F.lit(size)).cast("int"))
    numbers = placed.select(F.col("_block").alias("_of"), F.explode(F.array_distinct("sequence")).alias("index")).distinct()
    known = lookup_join(numbers, rows.select("index", F.col("vec").cast("array<float>").alias("vec")), "index")

    def flattened(block: pa.Table, found: pa.Table) -> pa.Table:
        found = found.sort_by("index")
        number = np.append(found.column("index").to_numpy(), -1)
        table = np.zeros((len(number), dimensions), np.float32)
        table[:-1] = found.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
        lists = block.column("sequence").combine_chunks()
        at = lists.flatten().to_numpy(zero_copy_only=False)
        place = np.searchsorted(number[:-1], at)
        place = np.where(number[place] == at, place, len(number) - 1)
        ends = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy())) * dimensions
        vectors = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(table[place].ravel()))
        return block.select(names).append_column(output, vectors)

    names = sequences.columns
    schema = StructType([*sequences.schema.fields, StructField(output, ArrayType(FloatType()))])
    flat = placed.groupBy("_block").cogroup(known.groupBy("_of")).applyInArrow(flattened, schema)
    return flat.withColumn(output, array_to_vector(output))


# Colour names of cluster numbers.
CLUSTER_COLOURS = ["red", "blue", "green", "violet", "yellow", "orange"]


def with_cluster_name(text: Column, cluster: Column) -> Column:
    """Text followed by the colour of its cluster and the word Cluster, for instance ``... redCluster``."""
    colour = F.element_at(F.array(*[F.lit(name) for name in CLUSTER_COLOURS]), cluster.cast("int") + 1)
    return F.concat_ws(" ", text, F.concat(colour, F.lit("Cluster")))


def with_cluster_terms(df: DataFrame, text: str, cluster: str, terms: DataFrame,
                       output: str = "content_with_top_terms") -> DataFrame:
    """Adds the text followed by the top terms of its cluster; ``terms`` is (cluster, rank, term)."""
    lines = terms.groupBy("cluster").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("rank", "term"))).getField("term"), " ").alias("_terms"))
    # One row per cluster of a fitted model; Spark sends it to the texts if it is as small as that.
    return (df.join(materialise(lines.withColumnRenamed("cluster", cluster)), cluster, "left")
            .withColumn(output, F.concat_ws(" ", text, "_terms")).drop("_terms"))
