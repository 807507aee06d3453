"""Sketches, cubes and chunks against plain counts."""

import random

import pytest
from pyspark.sql import functions as F

from tarn.operators import content_chunks as cc
from tarn.operators import lattice, sketches


def test_sketches(spark, tmp_path):
    r = random.Random(1)
    rows = [(p, r.randint(0, 3000), r.choice([None, r.gauss(0, 1)]), f"s{r.randint(0, 50)}") for p in ("a", "b", None) for _ in range(4000)]
    df = spark.createDataFrame(rows, "p string, k long, x double, s string")
    path = str(tmp_path / "sketches")
    sketches.store(df.where("p = 'a'"), F.col("p"), ["k", "x", "s"], path)
    sketches.store(df.withColumn("k", F.when(F.col("p") == "a", -1).otherwise(F.col("k"))), F.col("p"), ["k", "x", "s"], path)  # a is there already
    stored = sketches.stored(spark, path)
    assert stored.count() == 9
    for parts in (("a",), ("a", "b"), (None,), ("a", "b", None)):
        some = [x for x in rows if x[0] in parts]
        got = {r.column: r for r in sketches.merged(stored.where(F.col("part").isin(*[p for p in parts if p]) | (F.col("part").isNull() if None in parts else F.lit(False))), (0.1, 0.5)).collect()}
        for i, c in enumerate(("k", "x", "s"), 1):
            values = sorted(x[i] for x in some if x[i] is not None)
            assert (got[c].n, got[c].n_null) == (len(values), len(some) - len(values))
            assert abs(got[c].n_distinct - len(set(values))) <= max(1, len(set(values)) * sketches.distinct_bound())
            for q, at in zip(got[c].q or (), (0.1, 0.5), strict=False):
                assert abs(sum(v <= q for v in values) / len(values) - at) <= 2 * sketches.rank_bound()
        assert got["s"].q is None
    assert sketches.merged(sketches.build(df.where("x is null"), F.lit(1), ["x"])).first().n_distinct is None
    assert sketches.build(df.limit(0), F.col("p"), ["k"]).count() == 0


def test_cube(spark):
    r = random.Random(2)
    rows = [(r.choice(["a", "b", None]), r.choice([1, 2]), f"z{r.randint(0, 9)}", r.choice([None, r.randint(0, 9)])) for _ in range(500)]
    df = spark.createDataFrame(rows, "a string, b int, `c` string, v int")
    out = lattice.cube(df, ["a", "b", "c"], {"n": ("count", "v"), "s": ("sum", "v"), "low": ("min", "v"), "high": ("max", "v")})
    want = df.cube("a", "b", "c").agg(F.grouping_id().alias("g"), F.count("v"), F.sum("v"), F.min("v"), F.max("v"))
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, map(tuple, want.collect())))
    total = lattice.cube(df.limit(0), ["a", "b"], {"n": ("count", "v"), "s": ("sum", "v")}).collect()
    assert [tuple(x) for x in total] == [(None, None, 3, 0, None)]
    assert out.schema.names == ["a", "b", "c", "grouping_id", "n", "s", "low", "high"]


@pytest.mark.parametrize("sizes", [{}, {"least": 10, "mean": 16, "most": 60}])
def test_chunks_cover_once(spark, sizes):
    r = random.Random(3)
    texts = [None, "", "a", "ab" * 3000, "é" * 999] + ["".join(r.choice("abcdefgh é\n") for _ in range(r.randint(0, 9000))) for _ in range(20)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, no int, bytes string")
    parts = cc.chunks(df, **sizes).collect()
    for i, t in enumerate(texts):
        mine = sorted((p for p in parts if p.doc_id == i), key=lambda p: p.no)
        assert b"".join(p.bytes for p in mine) == (t or "").encode()
        assert [p.start for p in mine] == [sum(q.length for q in mine[:k]) for k in range(len(mine))]
        assert all(p.length <= (sizes.get("most") or cc.MOST) for p in mine) and all(p.length >= (sizes.get("least") or cc.LEAST) for p in mine[:-1])
    back = {x.doc_id: bytes(x.bytes) for x in cc.joined(cc.chunks(df, **sizes)).collect()}
    assert back == {i: t.encode() for i, t in enumerate(texts) if t}


def test_an_edit_moves_near_chunks_only(spark):
    r = random.Random(4)
    texts = ["".join(r.choice("abcdefgh ") for _ in range(100_000)) for _ in range(10)]
    edited = [t[:50_000] + "something new" + t[50_000:] if i % 2 else t for i, t in enumerate(texts)]
    old, new = (cc.chunks(spark.createDataFrame(list(enumerate(x)), "doc_id long, text string")) for x in (texts, edited))
    moved = cc.changed(new, old).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {x.doc_id for x in moved} == {1, 3, 5, 7, 9}
    assert all(x.n <= 4 * cc.MOST for x in moved) and cc.changed(old, old).count() == 0
    spread = [x.length for x in old.where("start + length < 100000").collect()]
    assert cc.LEAST < sum(spread) / len(spread) < cc.LEAST + 1.5 * cc.MEAN
