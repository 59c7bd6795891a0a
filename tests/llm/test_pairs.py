"""Suffix-array dedup, components and the n-gram join."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from newsframe.llm import suffixdedup
from newsframe.llm.components import connected_components
from newsframe.llm.jaccard import _fine, drop_similar, grid, similar_documents, tree_pairs
from newsframe.llm.suffixdedup import anchor_runs, common_prefixes, repeated_bytes, suffix_array


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(2)
    for size, letters in ((9, 1), (1, 2), (60, 2), (400, 1), (1500, 3), (3000, 200)):
        data = rng.integers(0, letters, size).astype(np.uint8)
        text, order = data.tobytes(), suffix_array(data)
        assert order.tolist() == sorted(range(size), key=lambda at: text[at:])
        for one, two, length in zip(order[:-1], order[1:], common_prefixes(data, order)[1:], strict=True):
            assert text[one:one + length] == text[two:two + length]
            assert max(one, two) + length == size or text[one + length] != text[two + length]


def plain_repeats(texts, length=100):
    """By row: sizes, removed bytes, spans and the digest of what stays; texts come in their order."""
    seen, rows = set(), []
    for text in texts:
        gone = np.zeros(len(text), bool)
        for at in range(len(text) - length + 1):
            window = text[at:at + length]
            if window in seen:
                gone[at:at + length] = True
            seen.add(window)
        kept = bytes(np.frombuffer(text, np.uint8)[~gone]) if text else b""
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        rows.append((len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return rows


@pytest.mark.parametrize("shard_bytes", [1 << 21, 700])
def test_repeated_bytes_against_brute_force(spark, shard_bytes):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcd é\n") for _ in range(rng.randint(0, 600))) for _ in range(15)]
    texts = []
    for _ in range(120):
        text = rng.choice(base)
        cut = rng.randint(0, len(text))
        texts.append(rng.choice([text, text[:cut] + "#" + text[cut:], text + text, "orre " * rng.randint(10, 200), "a" * rng.randint(50, 300),
                                 rng.choice(base)[cut:] + text, "\0" * rng.randint(90, 200) + "\0\0\1" + text]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {row[0]: tuple(row[1:]) for row in repeated_bytes(docs, shard_bytes=shard_bytes).collect()}
    assert [got[at] for at in range(len(texts))] == plain_repeats([text.encode() for text in texts])


def test_hot_anchors_do_not_meet_in_one_task(spark):
    """A common line with other neighbours in every text: its windows are dealt by their content."""
    rng = random.Random(6)
    line = "All rights reserved by the owners of this page and of the others of its site.\n"
    texts = ["".join(rng.choice("abcd ef") for _ in range(rng.randint(70, 90))) + line + "".join(rng.choice("ghi jkl") for _ in range(80)) for _ in range(300)]
    texts += [text[10:] for text in texts[::7]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {row[0]: tuple(row[1:]) for row in repeated_bytes(docs, shard_bytes=4_000).collect()}
    assert [got[at] for at in range(len(texts))] == plain_repeats([text.encode() for text in texts])
    raw = [text.encode() for text in texts]
    buffer, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(text) for text in raw])
    hashes, owner, _, _ = anchor_runs(buffer, offsets)
    common = [np.unique(hashes[owner == at][np.isin(hashes[owner == at], [h for h, n in zip(*np.unique(hashes, return_counts=True)) if n > 25])]) for at in range(len(raw))]
    lists = pa.array([row.view(np.int64).tolist() for row in common], pa.list_(pa.int64()))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(len(raw)), pa.int64()), pa.array([0] * len(raw), pa.int64()), pa.array([zstandard.compress(text) for text in raw]),
         pa.array([[]] * len(raw), pa.list_(pa.int64())), lists], ["doc", "tie", "packed", "anchors", "hot"])
    dealt = [route for rows in suffixdedup._stretches(iter([batch]), 100, 40)
             for route, size in zip(rows.column("route").to_pylist(), rows.column("bytes").to_pylist(), strict=True) if size]
    assert len(dealt) > 2000 and len(set(dealt)) == len(dealt)


def test_repeated_bytes_edge_rows(edge_docs, no_docs, spark):
    rows = repeated_bytes(edge_docs, keep_bytes=True).collect()
    assert len(rows) == 11 and repeated_bytes(no_docs).count() == 0
    long = next(row for row in rows if row.doc_id == 5)
    assert long.n_removed > 299_000 and bytes(long.kept) == b"word end"
    assert all(hashlib.sha256(bytes(row.kept)).hexdigest() == row.kept_sha256 and row.n_bytes - row.n_removed == len(row.kept) for row in rows)
    text = "xyz " * 2 + "".join(chr(97 + at % 23) + str(at) for at in range(60))
    same = repeated_bytes(spark.createDataFrame([(None, text), (4, text), (4, text), (4, text + "!")], "doc_id long, text string"))
    removed = sorted((row.doc_id or -1, row.n_removed) for row in same.collect())
    assert removed[0] == (-1, 0) and all(count >= len(text) - 1 for _, count in removed[1:])


def test_components(spark):
    path = [(at, at + 1) for at in range(200)]
    star = [(1000, 1000 + at) for at in range(1, 300)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(
        path + star + [(5000, 5000), (None, 3), (7000, 7001), (7001, 7000)], "a long, b long")).collect()}
    assert {got[at] for at in range(201)} == {0} and {got[1000 + at] for at in range(300)} == {1000}
    assert got[5000] == 5000 and got[7001] == 7000 and len(got) == 201 + 300 + 3
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_join(rows, words, num, den):
    sets = {}
    for key, text in rows:
        found = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[key] = {tuple(found[at:at + words]) for at in range(len(found) - words + 1)} or ({tuple(found)} if found else set())
    label = {key: key for key in sets}

    def root(key):
        while label[key] != key:
            key = label[key]
        return key

    keys = sorted(sets)
    for at, one in enumerate(keys):
        for two in keys[at + 1:]:
            a, b = sets[one], sets[two]
            if a and b and den * len(a & b) >= num * len(a | b):
                low, high = sorted((root(one), root(two)))
                label[high] = low
    return sorted((key, len(sets[key]), root(key)) for key in keys)


def near_texts(rng):
    base = [[rng.choice("abcdefghijklmnop") + str(rng.randint(0, 99)) for _ in range(rng.choice([1, 2, 3, 7, 20, 60, 150]))] for _ in range(20)]
    common = [f"c{at}" for at in range(50)]
    for _ in range(220):
        text = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 9])):
            text[rng.randrange(len(text))] = f"new{rng.randint(0, 400)}"
        if rng.random() < 0.2:
            text += common
        yield " ".join(text).upper() if rng.random() < 0.1 else " ".join(text)


@pytest.mark.parametrize("words,num", [(3, 90), (5, 80)])
def test_join_against_brute_force(spark, monkeypatch, words, num):
    monkeypatch.setattr("newsframe.llm.jaccard.BLOCK_ROWS", 24)
    rows = list(enumerate([*near_texts(random.Random(words)), "", None, " ", "one", "One", "one two", "two one"]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(row) for row in similar_documents(docs, words=words, num=num).collect())
    want = plain_join(rows, words, num, 100)
    assert got == want
    kept = sorted(row.doc_id for row in drop_similar(docs, words=words, num=num).collect())
    assert kept == sorted({row[2] for row in want})


def test_tree_pairs_lose_nothing():
    rng = np.random.default_rng(3)
    counts = np.concatenate([rng.poisson(3, (40, 32)) + rng.integers(0, 2, (40, 32))] + [np.tile(rng.poisson(5, 32), (30, 1)) + rng.integers(0, 2, (30, 32)) for _ in range(6)])
    component = rng.integers(0, 60, len(counts))
    sizes = counts.sum(1)
    for side in (np.zeros(len(counts), int), rng.integers(0, 2, len(counts))):
        one, two = tree_pairs(counts, side, component, 80, 100)
        got = {tuple(sorted(pair)) for pair in zip(one.tolist(), two.tolist(), strict=True)}
        want = set()
        for a in range(len(counts)):
            for b in range(a + 1, len(counts)):
                overlap = np.minimum(counts[a], counts[b]).sum()
                if component[a] != component[b] and (not side.any() or side[a] != side[b]) and 100 * overlap >= 80 * (sizes[a] + sizes[b] - overlap):
                    want.add((a, b))
        assert got == want


def test_fine_grid_loses_nothing():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 1 << 62, rng.choice([1, 90, 130, 700, 3000, 9000]), dtype=np.uint64)) for _ in range(12)]
    sets += [np.union1d(one[: int(len(one) * share)], np.unique(rng.integers(0, 1 << 62, max(1, len(one) // 9), dtype=np.uint64)))
             for one in sets for share in (0.7, 0.85, 0.95)]
    left, right = (np.array(side) for side in zip(*[(a, b) for a in range(len(sets)) for b in range(a)], strict=True))
    sizes = np.array([len(one) for one in sets])
    kept = _fine([grid(one) for one in sets], sizes, left, right, 80, 100)
    common = np.array([len(np.intersect1d(sets[a], sets[b])) for a, b in zip(left, right, strict=True)])
    true = 100 * common >= 80 * (sizes[left] + sizes[right] - common)
    assert true.sum() >= 10 and not (true & ~kept).any() and kept.sum() <= true.sum() + 12


def test_rows_of_one_key_are_judged_by_their_texts(spark):
    """Unlike texts of one key all stay and all their links count; copies of them go, whatever their keys are."""
    text = lambda name, changed=0: " ".join([f"{name}{at}" for at in range(60 - changed)] + ["new"] * changed)
    rows = [(1, text("a")), (1, text("b")), (1, text("c")), (1, text("c")), (2, text("b", 1)), (3, text("c")), (4, text("d")), (0, text("a", 1)),
            (None, text("a")), (5, None), (5, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hash", F.lit(2)).withColumn("__key", F.lit("k")).repartition(4)
    kept = drop_similar(docs)
    assert kept.columns == docs.columns
    assert sorted((str(row.doc_id), str(row.text)) for row in kept.collect()) == sorted(
        (str(key), str(value)) for key, value in [(0, text("a", 1)), (1, text("b")), (1, text("c")), (4, text("d")), *rows[-3:]])
    found = sorted((row.doc_id, row.component_id) for row in similar_documents(docs).collect() if row.doc_id is not None)
    assert found == sorted([(1, 0), (1, 1), (1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (0, 0), (5, 5), (5, 5)])


def test_join_edge_rows(edge_docs, no_docs):
    rows = similar_documents(edge_docs).collect()
    assert len(rows) == 11 and similar_documents(no_docs).count() == 0
    assert {(row.n_shingles, row.component_id) for row in rows if row.doc_id in (1, 7)} == {(2, 1)}
    assert all(row.component_id == row.doc_id for row in rows if row.doc_id in (2, 3, 4, None))
    kept = drop_similar(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted(str(row.doc_id) for row in kept.collect()) == sorted(map(str, [1, 2, 3, 4, 5, 6, 8, None, None]))
