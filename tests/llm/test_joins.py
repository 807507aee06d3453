"""N-gram join, suffix dedup and embedding join against brute force."""

import hashlib
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.llm import embedding_join, ngram_join, shared, suffix_dedup
from tarn.llm.shared import components

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Union:
    def __init__(self, ids):
        self.ids, self.up = ids, list(range(len(ids)))

    def find(self, i):
        while self.up[i] != i:
            i = self.up[i]
        return i

    def link(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)

    def least(self):
        m = {}
        for i, x in enumerate(self.ids):
            m[self.find(i)] = min(m.get(self.find(i), x), x)
        return [m[self.find(i)] for i in range(len(self.ids))]


def shingles(t):
    w = WORD.findall((t or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_ngrams(rows):
    sets, holders = [shingles(t) for _, t in rows], {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    u = Union([r[0] for r in rows])
    for a, b in {p for x in holders.values() for p in itertools.combinations(x, 2)}:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            u.link(a, b)
    return sorted((r[0], len(s), c) for r, s, c in zip(rows, sets, u.least(), strict=True))


def odd(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  b"), (6, "a b c"), (7, "x" * 50000), (8, "w " * 20000), (8, "w " * 20000), (9, "É a b c d e"), (10, "é a b c d e")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("cid", F.lit("clash"))


@pytest.mark.parametrize("held", [1_000_000, 3000])
def test_ngrams(spark, monkeypatch, held):
    monkeypatch.setattr(ngram_join, "HELD", held)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(120)]
    family = []
    for i in range(40):  # one large group of near copies
        w = list(words)
        for k in rng.integers(0, 120, rng.integers(0, 4)):
            w[k] = f"z{i}"
        family.append((10_000 + i, " ".join(w)))
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(family, "doc_id long, text string"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, ngram_join.joined(docs).collect())) == brute_ngrams(rows)


def test_ngrams_odd(spark):
    df = odd(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert sorted(map(tuple, ngram_join.joined(df).collect())) == brute_ngrams(rows)
    kept = ngram_join.deduplicated(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 6, 7, 8, 8, 9, 10]
    assert ngram_join.joined(df.limit(0)).count() == 0
    clash = df.selectExpr("*", "'a' AS key", "'b' AS row", "'c' AS _key", "1 AS n", "2 AS u")
    assert ngram_join.deduplicated(clash).columns == clash.columns and ngram_join.deduplicated(clash).where("key = 'a' AND row = 'b' AND n = 1").count() == 10


def test_ngrams_open_groups(spark):
    """Classes around shared passages that no hub links: chains of links, sizes at the threshold, many at one shingle."""
    rng = np.random.default_rng(11)
    core = [f"c{i}" for i in range(60)]
    rows = []
    for i in range(150):
        own = [f"o{i}_{k}" for k in range(int(rng.integers(0, 22)))]
        cut = int(rng.integers(0, 12))
        rows.append((i, " ".join(core[cut:] + own) if i % 3 else " ".join(own + core[: 60 - cut])))
    chain = [f"k{i}" for i in range(400)]
    rows += [(1000 + i, " ".join(chain[4 * i : 4 * i + 60])) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert sorted(map(tuple, ngram_join.joined(docs).collect())) == brute_ngrams(rows)


def thue_morse(n, flip=False):
    return "".join("ab"[(i.bit_count() + flip) % 2] for i in range(n))


def test_hashes_without_structure(spark):
    """Words that collide under every polynomial modulo 2^64 stay apart."""
    rows = [(k * 2 + f, thue_morse(1024 << k, bool(f))) for k in range(3) for f in range(2)] + [(50 + f, " ".join(f"w{i}" for i in range(40)) + " " + thue_morse(2048, bool(f)) + " x y z") for f in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.joined(docs).collect())) == brute_ngrams(rows)


def brute_bytes(rows):
    seen, out = set(), []
    for i, t in sorted(rows):
        t = t.encode()
        mark = bytearray(len(t))
        for p in range(len(t) - 99):
            if (w := t[p : p + 100]) in seen:
                mark[p : p + 100] = b"\x01" * 100
            else:
                seen.add(w)
        runs = sum(1 for k in range(len(t)) if mark[k] and (k == 0 or not mark[k - 1]))
        out.append((i, len(t), sum(mark), runs, hashlib.sha256(bytes(c for c, m in zip(t, mark, strict=True) if not m)).hexdigest()))
    return out


@pytest.mark.parametrize("sizes", [{}, {"most": 2, "batch_size": 500, "chunk": 3000}])
def test_suffixes(spark, sizes):
    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").where("doc_id < 400")
    passage = "a passage that many documents share, with enough bytes in it to be found as one: " * 2
    more = [(1001, None), (1002, ""), (1003, "x" * 5000), (1004, "ab" * 300), (1005, "y" + "ab" * 200), (1006, "x" * 99), (1007, "x" * 100)] + [(2000 + i, f"{i} {i * 7919} begins {passage}{i * 104729} ends") for i in range(60)]
    docs = base.union(spark.createDataFrame(more, "doc_id long, text string")).repartition(5)
    want = brute_bytes([(r.doc_id, r.text or "") for r in docs.collect()])
    got = suffix_dedup.deduplicated(docs, **sizes).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got)) == want


def test_suffixes_of_long_texts(spark):
    """Passages behind and across the ends of pieces are found; overlaps are no repetition."""
    rng = np.random.default_rng(7)
    word = lambda n: "".join(chr(c) for c in rng.integers(97, 123, n))
    passage, other = word(300), word(250)
    size = 1 << 10
    rows = [(1, passage + word(50)), (2, word(3 * size + 500) + passage + word(size) + other + word(700) + other + word(9)), (3, word(size - 150) + passage + word(20)), (4, word(2 * size - 550) + other + word(2 * size)), (5, word(size)), (6, word(size + 1)), (7, "ab" * 2 * size), (8, word(size - 200) + "q" * 3 * size)]
    got = suffix_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), bits=11).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got)) == brute_bytes(rows)


def test_suffix_positions():
    """Places of anchors past 2^24 bytes are true ones."""
    data = np.random.default_rng(1).integers(97, 123, (1 << 24) + 3000).astype(np.uint8)
    data[-1000:-500] = data[100:600]
    pieces = list(suffix_dedup._fitting([data.tobytes()], np.array([1]), 1 << 23))
    assert all(data[s[0] : s[0] + len(t[0])].tobytes() == t[0] for _, t, s in pieces) and pieces[-1][2][0] + len(pieces[-1][1][0]) == len(data)
    _, t, s = pieces[-1]
    last, head = suffix_dedup.anchors_of(t, np.array([1]), s), suffix_dedup.anchors_of([data[:700].tobytes()], np.array([1]), np.array([0]))
    place = {int(c): int(lo) for c, lo in zip(last["c"], last["lo"], strict=True)}
    moved = [place[int(c)] - int(lo) for c, lo in zip(head["c"], head["lo"], strict=True) if int(c) in place]
    assert len(moved) > 3 and set(moved) == {len(data) - 1100}


def test_suffix_family():
    """Levels grow geometrically and find what a dictionary finds."""
    rng = np.random.default_rng(2)
    n = 4000
    a = {"h": rng.integers(0, 300, n).astype("<u8"), "c": rng.integers(1, 5, n).astype("<u8"), "id": np.arange(n), "lo": np.zeros(n, dtype="<i4"), "off": np.zeros(n, dtype="u1"), "run": np.zeros(n, dtype="u1")}
    family, found = suffix_dedup.Family(), []
    for i in range(0, n, 100):
        part = {k: v[i : i + 100] for k, v in a.items()}
        found += (family.add(part) + i).tolist()
        assert len(family.levels) <= 12
    seen, want = set(), []
    for i, k in enumerate(zip(a["h"].tolist(), a["c"].tolist(), strict=True)):
        if k in seen:
            want.append(i)
        seen.add(k)
    assert sorted(found) == want and len(family.whole()["h"]) == len(seen)


def test_suffix_order():
    """Levels hold suffixes in the order of their bytes, zeros and high bytes included, each with the bytes that the text has there."""
    rng = np.random.default_rng(5)
    texts = [bytes(rng.choice(np.array([0, 1, 97, 98, 255], dtype=np.uint8), 900)) for _ in range(12)]
    family = suffix_dedup.Family()
    for i, t in enumerate(texts):
        family.add(suffix_dedup.anchors_of([t], np.array([i]), np.array([0])))
    w = family.whole()
    heads = [texts[i][lo + off :][: suffix_dedup.KGRAM] for i, lo, off in zip(w["id"], w["lo"], w["off"].astype(int), strict=True)]
    assert len(heads) > 150 and heads == sorted(heads) and [h.ljust(suffix_dedup.KGRAM, b"\0") for h in w["h"].tolist()] == heads


def test_cleaned(spark):
    passage = "".join(f"é{i}è" for i in range(100, 140))
    df = spark.createDataFrame([(1, passage, 200), (2, "start " + passage + " end", 210), (3, passage, 200), (4, None, 0)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in suffix_dedup.cleaned(df).collect()}
    assert got == {1: (passage, 200), 2: ("start  end", 10)}
    assert suffix_dedup.cleaned(df.limit(0)).count() == 0
    clash = df.selectExpr("*", "'a' AS _id", "'b' AS key", "'c' AS kept", "'d' AS row")
    assert {(r.doc_id, r._id, r.key, r.kept, r.row) for r in suffix_dedup.cleaned(clash).collect()} == {(1, "a", "b", "c", "d"), (2, "a", "b", "c", "d")}


def test_suffixes_of_structured_texts(spark):
    """Windows that differ only in a Thue-Morse word and its complement are no repetition."""
    rows = [(k * 2 + f, thue_morse(64 << k, bool(f)) + "tail" * 30) for k in range(5) for f in range(2)]
    got = suffix_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got)) == brute_bytes(rows)


def brute_vectors(rows, t=0.93):
    ok = [i for i, r in enumerate(rows) if r[2] is not None and r[1] is not None and len(r[1]) and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    u, links = Union([r[0] for r in rows]), [0] * len(rows)
    for a, b in itertools.combinations(ok, 2):
        x, y = (np.array(rows[k][1], dtype=float) / max(map(abs, rows[k][1])) for k in (a, b))
        if rows[a][2] == rows[b][2] and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= t:
            links[a] += 1
            links[b] += 1
            u.link(a, b)
    return sorted((r[0], n, c, r[0] == c) for r, n, c in zip(rows, links, u.least(), strict=True))


@pytest.mark.parametrize("cell,block", [(4096, 4096), (40, 30)])
def test_vectors(spark, monkeypatch, cell, block):
    monkeypatch.setattr(embedding_join, "CELL", cell)
    monkeypatch.setattr(embedding_join, "BLOCK", block)
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in v], int(i % 3)) for i, v in enumerate(rng.normal(size=(240, 8)))]
    rows += [(300 + i, [x * 2 for x in rows[i][1]], rows[i][2]) for i in range(20)] + [(400 + i, rows[5][1], 2) for i in range(30)]
    rows += [(500 + i, [1.0 + 0.02 * float(x) for x in rng.normal(size=8)], 1) for i in range(80)]
    rows += [(600, None, 1), (601, [0.0] * 8, 1), (602, [None] + [1.0] * 7, 1), (603, [float("nan")] * 8, 1), (604, [1.0] * 8, None), (605, [], 1), (606, [1.0, 2.0], 1), (607, [2.0, 4.0], 1)]
    rows += [(700, [1e200] * 8, 1), (701, [3e-200] * 8, 1), (702, [1e308] * 7 + [9e307], 1)]
    rows += [(7, rows[9][1], rows[9][2]), (7, rows[300][1], rows[300][2]), (510, rows[11][1], rows[11][2]), (511, rows[12][1], rows[12][2])]  # different vectors under one id
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, embedding_join.linked(df).collect())) == brute_vectors(rows)
    assert embedding_join.linked(df.limit(0)).count() == 0
    clash = df.selectExpr("*", "'a' AS id", "'b' AS v", "'c' AS g1", "1 AS n").where("vec_id < 20")
    assert embedding_join.linked(clash).count() == clash.count()


def test_vectors_that_are_only_null(spark):
    df = spark.createDataFrame([(1, None, 1), (2, [None, None], 1), (3, [0.0], None)], "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, embedding_join.linked(df).collect())) == [(i, 0, i, True) for i in (1, 2, 3)]


def test_boundaries_prune(spark, monkeypatch):
    """Vectors around a few directions go to few cells; links stay exact."""
    monkeypatch.setattr(embedding_join, "CELL", 40)
    rng = np.random.default_rng(8)
    centres = np.eye(12)[:8] * 3
    rows = [(i, [float(x) for x in centres[i % 8] + 0.25 * rng.normal(size=12)], 1) for i in range(320)]
    made = []
    real = embedding_join.saved
    monkeypatch.setattr(embedding_join, "saved", lambda df, name: made.append((name, out := real(df, name), out.count())) or out)
    got = embedding_join.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted(map(tuple, got)) == brute_vectors(rows)
    assert next(n for name, _, n in made if name == "cells") < 2.5 * len(rows)


def test_components(spark):
    rng = np.random.default_rng(9)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000 + i, 1001 + i) for i in range(50)] + [(3, 3)]
    u = Union(list(range(1100)))
    for a, b in edges:
        u.link(a, b)
    touched = {x for e in edges if e[0] != e[1] for x in e}
    want = {(i, c) for i, c in enumerate(u.least()) if i in touched}
    assert {tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == want


def test_wanted_filter(spark, monkeypatch):
    """Ids that are wanted always pass, of a full filter too; most others do not, if it has room."""
    docs = spark.createDataFrame([(i, "x") for i in [-5, *range(3000)]] + [(None, "x")], "id long, text string")
    wanted = docs.where("id % 10 = 0 or id = -5").select("id")
    keep = {-5, *range(0, 3000, 10)}
    got = {r.id for r in docs.where(shared.among(shared.among_hashes(wanted))(F.col("id"))).collect()}
    assert keep <= got and len(got) < 450
    assert docs.where(shared.among(shared.among_hashes(wanted.where("false")))(F.col("id"))).count() == 0
    monkeypatch.setattr(shared, "MAX_BITS", 64)
    assert keep <= {r.id for r in docs.where(shared.among(shared.among_hashes(wanted))(F.col("id"))).collect()}
