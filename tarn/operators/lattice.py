"""Cubes from partial results: the input is aggregated once, by all dimensions.

Every other grouping comes from the smallest one that is already there and has one dimension more, so the rows that are shuffled
shrink from level to level, where a single expansion of the input would copy each row for every grouping.  Measures are such that
partial results add up: sum, count, min and max.  Each grouping is written, and its number of rows tells which parent is the smallest.

A null in a dimension is a value of its own; ``grouping_id`` has a bit for each dimension, 1 where it is rolled up, the first dimension's the
highest.  An empty input has no rows but that of the grand total, as in SQL.
"""

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.sources.catalog import scratch_dir

AGAIN = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
FIRST = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


def cube(df: DataFrame, dims: list[str], measures: dict[str, tuple[str, str]]) -> DataFrame:
    """dims, grouping_id, measures; a measure is name: (sum, count, min or max; column)."""
    spark, base = df.sparkSession, scratch_dir(df.sparkSession)
    groupings: dict[tuple[str, ...], tuple[DataFrame, int]] = {}

    def kept(frame: DataFrame, some: tuple[str, ...]) -> None:
        path = f"{base}/{'-'.join(str(dims.index(d)) for d in some) or 'all'}"
        frame.write.parquet(path)
        back = spark.read.schema(frame.schema).parquet(path)
        groupings[some] = back, back.count()

    first = [FIRST[f](F.col(f"`{c}`")).alias(name) for name, (f, c) in measures.items()]
    kept(df.groupBy(*[F.col(f"`{d}`") for d in dims]).agg(*first), tuple(dims))
    for n in range(len(dims) - 1, -1, -1):
        for some in combinations(dims, n):
            parent, _ = min((groupings[p] for p in groupings if len(p) == n + 1 and set(some) < set(p)), key=lambda x: x[1])
            again = [(F.coalesce(F.sum(name), F.lit(0)) if f == "count" else AGAIN[f](name)).alias(name) for name, (f, _) in measures.items()]
            kept(parent.groupBy(*some).agg(*again), some)
    out = None
    for some, (frame, _) in groupings.items():
        gid = sum((d not in some) << (len(dims) - 1 - i) for i, d in enumerate(dims))
        cols = [F.col(d) if d in some else F.lit(None).cast(df.schema[d].dataType).alias(d) for d in dims]
        part = frame.select(*cols, F.lit(gid).cast("long").alias("grouping_id"), *measures)
        out = part if out is None else out.unionByName(part)
    return out
