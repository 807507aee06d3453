"""Repeated windows of words against brute force, whole and in tiny pieces."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.llm import debruijn as g
from tarn.llm.shared import row_key


def rows():
    r = random.Random(5)
    vocab = ["a", "bb", "é", "x" * 9, "y" * 70, "z" * 200]
    base = [" ".join(r.choice([*vocab, f"w{r.randint(0, 300)}"]) for _ in range(r.randint(0, 150))) for _ in range(30)]
    out = []
    for i in range(200):
        parts = []
        for _ in range(r.randint(0, 3)):
            b = r.choice(base).split()
            a = r.randint(0, max(0, len(b) - 1))
            parts += b[a : a + r.randint(5, 80)]
            if r.random() < 0.3:
                parts.insert(r.randint(0, len(parts)), f"new{i}")
        out.append((r.choice([i, i, i, None, i // 2]), r.choice([" ", "\n", "\t "]).join(parts) if parts else r.choice([None, ""])))
    return out + [(1000 + i, "s " * 40) for i in range(5)] + [(None, base[3])] * 2 + [(7, base[5]), (7, base[5]), (7, base[6])]


def brute(spark, given):
    keys = {r.text: r.k for r in spark.createDataFrame([(None, t) for _, t in given], "doc_id long, text string").select("text", row_key(F.col("doc_id")).alias("k")).collect()}
    docs = [(keys[t] if i is None else i, (t or "").encode().split(), i) for i, t in given]
    first, out = {}, []
    for i, w, _ in docs:
        for k in range(len(w) - 12):
            s = tuple(w[k : k + 13])
            first[s] = min(first.get(s, i), i)
    for i, w, own in docs:
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        out.append((str(own), len(w), sum(gone), b" ".join(x for x, y in zip(w, gone, strict=True) if not y).decode()))
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"part": 300, "held": 50, "asked": 2}, {"part": 40, "held": 1}])
def test_against_brute_force(spark, sizes):
    given = rows()
    df = spark.createDataFrame([(*x, "c", 1) for x in given], "doc_id long, text string, lo string, `n.n` int").repartition(5)
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in g.deduplicated(df, **sizes).collect())
    assert got == brute(spark, given)


def test_empty_and_few_words(spark):
    assert g.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = g.deduplicated(spark.createDataFrame([(1, None), (2, " \n "), (3, "a  b"), (4, "a b")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_removed, r.kept) for r in got] == [(0, 0, ""), (0, 0, ""), (2, 0, "a b"), (2, 0, "a b")]


def test_spans_are_long(spark):
    """A copied passage is one span with its source's coordinates, not one for each window."""
    words = [f"w{k}" for k in range(400)]
    docs = [(1, " ".join(words)), (2, "new words first " + " ".join(words[100:300])), (3, " ".join(words))]
    whole = spark.createDataFrame(docs, "id long, text string").select("id", F.xxhash64("text").alias("row"), "text")
    got = sorted((r.id, r.lo, r.n, r.src, r.src_lo) for r in g.spans_of(whole).collect())
    assert got == [(2, 3, 188, 1, 100), (3, 0, 388, 1, 0)]


def test_false_spans_are_not_cut(spark):
    """A span whose words differ from those at its source stays."""
    import pyarrow as pa

    words = " ".join(f"w{k}" for k in range(20)).encode()
    right = g.digest(words.split(), 2, 3)
    out = g._cut(pa.array([words, words], pa.binary()), pa.array([[{"lo": 2, "n": 3, "digest": right}], [{"lo": 3, "n": 3, "digest": right}]]))
    assert [r["n_removed"].as_py() for r in out] == [15, 0]


def test_word_hashes_tell_words_apart():
    data = np.frombuffer(b"a aa ab ba abcdefgh abcdefghi abcdefghij \x00 " + b"q" * 64 + b" " + b"q" * 65 + b" a", dtype=np.uint8)
    starts, ends, h = g.word_hashes(data)
    assert [data[s:e].tobytes() for s, e in zip(starts, ends, strict=True)] == data.tobytes().split()
    assert h[0] == h[-1] and len(set(h.tolist())) == len(h) - 1
