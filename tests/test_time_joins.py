"""As-of and interval joins against plain loops."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tarn.operators import asof, intervals


def sides(n=150):
    r = random.Random(6)
    keys, times = ["a", "b", "hot", "hot", "hot", None], [*range(30), None]
    left = [(i, r.choice(keys), r.choice(times), "l") for i in range(n)]
    right = [(i, r.choice(keys), r.choice(times), r.choice([None, 1, 2, 3])) for i in range(n // 2)]
    return left, right + [(999, "hot", 5, 3)] * 2


def plain(left, right, strict, tolerance):
    out = []
    for i, k, t, _ in left:
        best = None
        for j, rk, rt, tie in right:
            if None not in (k, t, rk, rt) and rk == k and (rt < t or rt == t and not strict):
                best = max(best or (rt, -1, None), (rt, -1 if tie is None else tie, None), key=lambda x: x[:2])
        if best and tolerance is not None and t - best[0] > tolerance:
            best = None
        out.append((i, best and best[0], best and (None if best[1] == -1 else best[1])))
    return sorted(out, key=str)


@pytest.mark.parametrize("strict,tolerance,slices", [(False, None, 64), (True, None, 64), (False, 3, 5), (True, 0, 2), (False, None, 1)])
def test_as_of(spark, strict, tolerance, slices):
    left, right = sides()
    a = spark.createDataFrame(left, "id int, k string, t long, side string")
    b = spark.createDataFrame(right, "id int, k string, t long, tie int")
    out = asof.as_of(a, b, ["k"], "t", "t", tie="tie", strict=strict, tolerance=tolerance, slices=slices)
    assert out.columns == ["id", "k", "t", "side", "right_id", "right_k", "right_t", "right_tie"]
    assert sorted(((r.id, r.right_t, r.right_tie) for r in out.collect()), key=str) == plain(left, right, strict, tolerance)


def test_as_of_two_keys_and_timestamps(spark):
    t = [datetime(2024, 1, 1) + timedelta(hours=h) for h in range(5)]
    a = spark.createDataFrame([(1, "x", t[3]), (2, "x", t[3])], "k int, slice string, t timestamp")
    b = spark.createDataFrame([(1, "x", t[1], 1), (1, "x", t[2], 2), (1, "y", t[3], 3)], "k int, slice string, t timestamp, v int")
    got = sorted((r.k, r.right_v) for r in asof.as_of(a, b, ["k", "slice"], "t", "t").collect())
    assert got == [(1, 2), (2, None)]
    assert asof.as_of(a, b, ["k", "slice"], "t", "t", tolerance=3599).where("right_v is not null").count() == 0
    assert asof.as_of(a.limit(0), b, ["k"], "t", "t").count() == 0
    assert [r.right_v for r in asof.as_of(a, b.limit(0), ["k"], "t", "t").collect()] == [None, None]


def spans(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        s = r.randint(-200, 200)
        out.append((i, r.choice(["a", "b", None]), s, s + r.choice([0, 0, 1, 2, 7, 8, 9, 300, -1])))
    return out + [(n, "a", None, 3), (n + 1, "a", 3, None), (n + 2, "b", -5000, 5000), (n + 2, "b", -5000, 5000)]


@pytest.mark.parametrize("keys,half_open", [([], False), (["k"], False), (["k"], True), ([], True)])
def test_overlapping(spark, keys, half_open):
    left, right = spans(60, 1), spans(50, 2)
    a, b = (spark.createDataFrame(x, "id int, k string, s long, e long") for x in (left, right))
    out = intervals.overlapping(a, b, ("s", "e"), ("s", "e"), keys, half_open)
    assert out.columns == [f"{p}{c}" for p in ("left_", "right_") for c in ("id", "k", "s", "e")]

    def meet(x, y):
        if None in (x[2], x[3], y[2], y[3]) or (keys and (x[1] is None or x[1] != y[1])):
            return False
        if half_open:
            return x[2] < x[3] and y[2] < y[3] and x[2] < y[3] and y[2] < x[3]
        return x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3]

    assert sorted((r.left_id, r.right_id) for r in out.collect()) == sorted((x[0], y[0]) for x in left for y in right if meet(x, y))
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_overlapping_edges(spark):
    a = spark.createDataFrame([(1, 5, 5)], "id int, s long, e long")
    assert intervals.overlapping(a, a, ("s", "e"), ("s", "e")).count() == 1
    assert intervals.overlapping(a.limit(0), a, ("s", "e"), ("s", "e")).count() == 0
    assert intervals.overlapping(a, a.limit(0), ("s", "e"), ("s", "e")).count() == 0
    t = datetime(2024, 1, 1)
    b = spark.createDataFrame([(t, t + timedelta(microseconds=1)), (t + timedelta(microseconds=1), t + timedelta(days=400))], "s timestamp, e timestamp")
    assert intervals.overlapping(b, b, ("s", "e"), ("s", "e")).count() == 4
    assert intervals.overlapping(b, b, ("s", "e"), ("s", "e"), half_open=True).count() == 2


def test_a_long_interval_is_not_copied_to_short_buckets(spark):
    a = spark.createDataFrame([(0, 1 << 40)], "s long, e long")
    b = spark.createDataFrame([(i, i) for i in range(20)], "s long, e long")
    side = intervals._side(a, [], "s", "e", False)
    assert intervals._at(side, side["level"]).count() <= 2
    assert intervals.overlapping(a, b, ("s", "e"), ("s", "e")).count() == 20


def test_hot_key_is_cut_into_slices(spark):
    """One key's times fall into about equal slices, so that no window holds most of its rows."""
    from pyspark.sql import functions as F

    times = spark.range(1000).select((F.col("id") * F.col("id")).cast("long").alias("t"))
    edges = asof._edges(times, times, 8)
    assert len(edges) == 7
    sizes = [r["count"] for r in times.groupBy(asof._slice(F.col("t"), edges).alias("s")).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 200


@pytest.mark.parametrize("keys,half_open,slice_rows", [([], False, 100_000), ([], True, 5), (["k"], False, 5), (["k"], True, 100_000)])
def test_summed_equals_pairs(spark, keys, half_open, slice_rows):
    """Numbers and sums of overlapping rows as from all pairs, with repeated rows, points, nulls and ends before starts; no pair is made."""
    r = random.Random(9)
    rows = lambda n: [(r.choice([1, 2, None]), i // 2, s := r.choice([None, *range(30)]), None if s is None else s + r.choice([-1, 0, 0, 1, 3, 12])) for i in range(n)]
    left, right = (spark.createDataFrame(rows(n), "k long, id long, s long, e long") for n in (60, 90))
    pairs = intervals.overlapping(left, right, ("s", "e"), ("s", "e"), keys, half_open)
    own = [f"left_{c}" for c in left.columns]
    want = pairs.groupBy(*own).agg(F.count("*").alias("n"), F.sum("right_id").alias("total"))
    out = intervals.summed(left, right, ("s", "e"), ("s", "e"), "id", keys, half_open, slice_rows)
    got = out.groupBy(*own).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 5
    assert "shiftright" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_slices_are_dealt_out_by_rows(spark, monkeypatch):
    """More rows make more tasks, whatever the number of shuffle partitions; slices are not sorted before they are dealt out."""
    monkeypatch.setattr(asof, "ROWS", 40, raising=False)
    left, right = sides()
    a = spark.createDataFrame(left, "id int, k string, t long, side string")
    b = spark.createDataFrame(right, "id int, k string, t long, tie int")
    out = asof.as_of(a, b, ["k"], "t", "t", tie="tie")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert f", {(len(left) + len(right)) // 40 + 1}), REPARTITION_BY_NUM" in plan
    assert sorted(((r.id, r.right_t, r.right_tie) for r in out.collect()), key=str) == plain(left, right, False, None)
