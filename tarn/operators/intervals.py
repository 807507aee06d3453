"""Interval join: pairs of intervals that overlap, by equi-joins on buckets.

An interval's level is that of the shortest bucket, of lengths 1, 2, 4 ..., which is at least as long, so at its own
level it lies in at most two buckets.  A pair meets at the level of its longer interval: this one is there at its own level, the
shorter one is sent to each level that the other side has above its own, to at most two buckets there.  A long interval is therefore never copied
to many short buckets, and a row is copied at most twice for each different level of the other side (64 at the most).
Both may touch the same two buckets; the pair counts in the bucket where the later of the two begins, so no pair is made twice and
nothing is removed afterwards.  Points are intervals of length 0.

The two joins are on (keys, level, bucket), sort-merge, so adaptive execution splits crowded buckets.

Intervals are closed, or without their end if ``half_open``; then empty ones overlap nothing.  Ends are whole
numbers, dates or timestamps (compared in microseconds).  Intervals with a null or an end before the start, and rows with a null key, pair with nothing.
Repeated rows pair each.

``summed`` gives how many right rows overlap each left one and the sum of a column of theirs without making a pair: those that begin until
the left one's end less those that end before its start, both read from running sums over time.  These run within slices of
time, whose number grows with the rows, and begin with what earlier slices hold.

The result of ``overlapping`` has both sides' columns with a prefix each, so equal names do not clash.
"""

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.times import ticks

SLICES, SLICE_ROWS = 1024, 100_000  # at most, and about so many different times in a slice


def _level(length: Column) -> Column:
    """The smallest l with 2^l >= length: the bits of length - 1."""
    return F.when(length <= 1, 0).otherwise(F.length(F.regexp_replace(F.bin(length - 1), "^0+", ""))).cast("int")


def _side(df: DataFrame, keys: list[str], start: str, end: str, half_open: bool) -> DataFrame:
    names = [f"k{i}" for i in range(len(keys))]
    row = F.struct(*[F.col(f"`{x}`").alias(x) for x in df.columns]).alias("row")
    s, e = ticks(df, start).cast("long"), ticks(df, end).cast("long")
    out = df.select(row, *[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names, strict=True)], s.alias("s"), (e - 1 if half_open else e).alias("e"))
    out = out.where("s <= e" + "".join(f" AND {n} IS NOT NULL" for n in names))
    return out.withColumn("level", _level(F.col("e") - F.col("s") + 1))


def _at(side: DataFrame, level: Column) -> DataFrame:
    """Rows in the buckets (at, bucket) that they touch at a level not below their own."""
    there = side.withColumn("at", level)
    first, last = F.expr("shiftright(s, at)"), F.expr("shiftright(e, at)")
    return there.withColumn("bucket", F.explode(F.when(first == last, F.array(first)).otherwise(F.array(first, last))))


def _sent(side: DataFrame, levels: list[int], strictly: bool) -> DataFrame:
    """Rows at each of the other side's levels from their own on, or above it."""
    chosen = F.filter(F.array(*[F.lit(x) for x in levels]).cast("array<int>"), lambda x: (x > F.col("level")) if strictly else (x >= F.col("level")))
    return _at(side, F.explode(chosen))


def overlapping(left: DataFrame, right: DataFrame, left_ends: tuple[str, str], right_ends: tuple[str, str], keys: list[str] | None = None, half_open: bool = False, prefixes: tuple[str, str] = ("left_", "right_")) -> DataFrame:
    """Pairs of a left and a right row with equal keys and a point in common."""
    keys = keys or []
    names = [f"k{i}" for i in range(len(keys))]
    a, b = _side(left, keys, *left_ends, half_open), _side(right, keys, *right_ends, half_open)
    levels = [sorted(r["level"] for r in x.select("level").distinct().collect()) for x in (a, b)]  # at most 64 numbers each
    on = [*names, "at", "bucket"]

    def met(long: DataFrame, short: DataFrame, long_side: str) -> DataFrame:
        x = long.select(*on, F.col("row").alias("x"), F.col("s").alias("xs"), F.col("e").alias("xe"))
        y = short.select(*on, F.col("row").alias("y"), F.col("s").alias("ys"), F.col("e").alias("ye"))
        both = x.join(y, on).where((F.col("xs") <= F.col("ye")) & (F.col("ys") <= F.col("xe")) & (F.col("bucket") == F.expr("shiftright(greatest(xs, ys), at)")))
        return both.select(*[F.col(c).alias(n) for c, n in zip(("x", "y") if long_side == "left" else ("y", "x"), ("l", "r"), strict=True)])

    pairs = met(_at(a, F.col("level")), _sent(b, levels[0], False), "left").unionAll(met(_at(b, F.col("level")), _sent(a, levels[1], True), "right"))
    cols = [F.col(f"{s}.`{c}`").alias(f"{p}{c}") for s, df, p in (("l", left, prefixes[0]), ("r", right, prefixes[1])) for c in df.columns]
    return pairs.select(*cols)


def summed(left: DataFrame, right: DataFrame, left_ends: tuple[str, str], right_ends: tuple[str, str], value: str, keys: list[str] | None = None, half_open: bool = False, slice_rows: int = SLICE_ROWS, prefix: str = "left_") -> DataFrame:
    """Left rows that overlap a right row of equal keys, with n, the number of these, and total, the sum of their ``value`` (whole numbers; null adds nothing)."""
    keys = keys or []
    names = [f"k{i}" for i in range(len(keys))]
    a, b = _side(left, keys, *left_ends, half_open), _side(right, keys, *right_ends, half_open)
    v, zero, one = F.coalesce(F.col(f"row.`{value}`").cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"), F.lit(1).cast("long")
    none, sums = F.lit(0).cast("long"), ["begun", "begun_total", "over", "over_total"]
    steps = [
        b.select(*names, F.col("s").alias("t"), one.alias("begun"), v.alias("begun_total"), none.alias("over"), zero.alias("over_total"), F.lit(False).alias("asked")),
        b.select(*names, F.col("e") + 1, none, zero, one, v, F.lit(False)),
        *[a.select(*names, x, none, zero, none, zero, F.lit(True)) for x in ("s", "e")],
    ]
    # at one time all steps count, so a row a time is enough
    times = reduce(DataFrame.unionAll, steps).groupBy(*names, "t").agg(*[F.sum(c).cast("decimal(38,0)" if "total" in c else "long").alias(c) for c in sums], F.max("asked").alias("asked"))
    got = times.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("t", [i / SLICES for i in range(1, SLICES)], 10 * SLICES).alias("q")).first()
    edges = np.array(sorted(set((got["q"] or [])[:: max(1, SLICES * slice_rows // max(got["n"], 1))])) if got["n"] > slice_rows else [], dtype=np.int64)

    @F.pandas_udf("int")
    def slice_of(t: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, t.to_numpy(), side="right").astype(np.int32))

    times = times.withColumn("slice", slice_of("t") if len(edges) else F.lit(0))
    running = lambda w: [F.sum(c).over(w).alias(c) for c in sums]
    whole = times.groupBy(*names, "slice").agg(*[F.sum(c).alias(c) for c in sums])
    before = whole.select(*names, "slice", *running(Window.partitionBy(*names).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)))  # at most SLICES rows a key
    before = before.select(*names, "slice", *[F.coalesce(c, F.lit(0)).alias(f"before_{c}") for c in sums])
    here = times.select(*names, "slice", "t", "asked", *running(Window.partitionBy(*names, "slice").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)))
    known = here.where("asked").join(before, [*names, "slice"]).select(*names, "t", *[(F.col(c) + F.col(f"before_{c}")).alias(c) for c in sums])
    until = known.select(*names, F.col("t").alias("e"), "begun", "begun_total")
    ended = known.select(*names, F.col("t").alias("s"), "over", "over_total")
    out = a.join(until, [*names, "e"]).join(ended, [*names, "s"]).withColumn("n", F.col("begun") - F.col("over")).where("n > 0")
    return out.select(*[F.col(f"row.`{x}`").alias(f"{prefix}{x}") for x in left.columns], "n", (F.col("begun_total") - F.col("over_total")).cast("long").alias("total"))
