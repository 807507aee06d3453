"""As-of join: each left row takes the last right row of its key that is not later.

Both sides become one tagged sequence of (key, time): right rows reduced to the last of each (key, time), left
rows to the different (key, time) that they ask for.  The sequence is cut into slices of time, so that a key which holds much of
all rows is carried in many tasks:

1. Within each (key, slice) the last right row is found; running over the slices of a key, of which there are at most
   ``slices``, gives what each slice begins with.
2. Within each (key, slice), in order of time, the last right row is carried along, beginning with that.

Slices are dealt out to tasks of about ROWS rows, however many rows there are, so a task's sorts take bounded memory.

Left rows then meet their answer in a join on (key, time), whose large partitions adaptive execution splits, so many left rows
at one instant do not sit in one window either.

A right row at the very time counts unless ``strict``; of several right rows at one time the one with the largest ``tie``
counts, a null tie being the smallest; with ``tolerance`` (in the unit of time, seconds for timestamps), older ones don't count.  Left rows stay all, with
nulls where nothing matches; null keys and null times match nothing, and right rows with these are never taken. The result has
the left columns, and the right ones with a prefix, so equal names do not clash.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.times import MICROS, is_time, ticks

SLICES = 64
ACCURACY = 1000  # of the quantiles that cut slices
ROWS = 1 << 18  # that a task carries along, about


def _slice(t: Column, edges: list) -> Column:
    """How many edges are at or before t."""
    if not edges:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= t))


def _edges(left: DataFrame, right: DataFrame, slices: int) -> list:
    """Times that cut all rows of both sides into about equal slices; at most ``slices`` - 1 numbers come to the driver."""
    both = left.select("t").unionAll(right.select("t"))
    got = both.agg(F.percentile_approx("t", [i / slices for i in range(1, slices)], ACCURACY).alias("q")).first()["q"] if slices > 1 else []
    return sorted(set(got or []))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, tie: str | None = None, strict: bool = False, tolerance: float | None = None, prefix: str = "right_", slices: int = SLICES) -> DataFrame:
    """Left rows with the last earlier right row of equal keys."""
    c = lambda n: F.col(f"`{n}`")
    names = [f"k{i}" for i in range(len(keys))]
    key_cols = [c(k).alias(n) for k, n in zip(keys, names, strict=True)]
    has_key = " AND ".join([f"{n} IS NOT NULL" for n in [*names, "t"]])
    whole = F.struct(*[c(x).alias(x) for x in right.columns]).alias("row")
    asked = left.select(F.struct(*[c(x).alias(x) for x in left.columns]).alias("own"), *key_cols, ticks(left, left_time).alias("t"))
    given = right.select(*key_cols, ticks(right, right_time).alias("t"), (c(tie) if tie else F.lit(0)).alias("tie"), whole).where(has_key)
    lasts = given.groupBy(*names, "t").agg(F.max_by("row", F.struct(F.col("tie").isNotNull(), "tie")).alias("row"))
    times = asked.where(has_key).select(*names, "t").distinct()
    edges = _edges(times, lasts, slices)
    none = F.lit(None).cast(lasts.schema["row"].dataType)
    # at one time, a question comes after the right row, or before it if strict
    tagged = lasts.select(*names, "t", F.lit(1 if strict else 0).alias("side"), F.struct("t", "row").alias("last")).unionAll(times.select(*names, "t", F.lit(0 if strict else 1), F.struct(F.lit(None).cast(lasts.schema["t"].dataType).alias("t"), none.alias("row"))))
    is_right = F.col("side") == (1 if strict else 0)
    tagged = tagged.withColumn("slice", _slice(F.col("t"), edges)).withColumn("last", F.when(is_right, F.col("last")))
    tagged = tagged.repartition((left.count() + right.count()) // ROWS + 1, *names, "slice")
    ends = tagged.groupBy(*names, "slice").agg(F.max_by("last", F.when(is_right, F.col("t"))).alias("last"))
    over_slices = Window.partitionBy(*names).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("carried", F.last("last", ignorenulls=True).over(over_slices)).select(*names, "slice", "carried")
    within = Window.partitionBy(*names, "slice").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    filled = tagged.withColumn("here", F.last("last", ignorenulls=True).over(within)).where(~is_right)
    answers = filled.join(carried, [*names, "slice"], "left").select(*names, "t", F.coalesce("here", "carried").alias("last"))
    out = asked.join(answers, [*names, "t"], "left")
    found = F.col("last.row")
    if tolerance is not None:
        unit = MICROS if is_time(left, left_time) else 1
        found = F.when(F.col("t") - F.col("last.t") <= tolerance * unit, found)
    out = out.select("own", found.alias("row"))
    return out.select(*[F.col(f"own.`{x}`").alias(x) for x in left.columns], *[F.col(f"row.`{x}`").alias(f"{prefix}{x}") for x in right.columns])
