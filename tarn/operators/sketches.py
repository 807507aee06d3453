"""Sketches of columns, kept for each part of a table and merged for any union of parts.

``build`` makes, in one pass, a row for each part and column: rows, nulls, least and largest value, a distinct-count sketch and, for numbers, a quantile
sketch.  ``store`` appends rows for parts that a stored table lacks, so new data is read once and old data not again.  ``merged``
answers for any set of parts from the stored rows alone.

Bounds: the distinct count has a relative standard error of 1.04 / sqrt(2^LG_K), of which ``distinct_bound`` is the threefold; a quantile's
rank is off by at most 2.446 / K^0.9433 of the rows with 99 % confidence (``rank_bound``).  Small counts are exact: below the sketch's size
nothing is lost.  Nulls are counted apart; a null part is a part; a column of nulls has no sketch and null estimates.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

LG_K, K = 14, 400


def distinct_bound(lg_k: int = LG_K) -> float:
    return 3 * 1.04 / (1 << lg_k) ** 0.5


def rank_bound(k: int = K) -> float:
    return 2.446 / k**0.9433


def build(df: DataFrame, part: Column, columns: list[str], lg_k: int = LG_K, k: int = K) -> DataFrame:
    """part (text), column, n, n_null, low, high (text), distinct, quantiles (sketches)."""
    made = []
    for i, c in enumerate(columns):
        v = F.col(f"`{c}`")
        number = isinstance(df.schema[c].dataType, NumericType)
        quantiles = F.kll_sketch_agg_double(v.cast("double"), F.lit(k)) if number else F.lit(None).cast("binary")
        made.append(F.struct(F.lit(c).alias("column"), F.count(v).alias("n"), F.count_if(v.isNull()).alias("n_null"), F.min(v).cast("string").alias("low"), F.max(v).cast("string").alias("high"), F.hll_sketch_agg(v.cast("string"), F.lit(lg_k)).alias("distinct"), quantiles.alias("quantiles")).alias(f"c{i}"))
    per = df.groupBy(part.cast("string").alias("part")).agg(*made)
    flat = per.select("part", F.explode(F.array(*[F.col(f"c{i}") for i in range(len(columns))])).alias("x")).select("part", "x.*")
    none = F.col("n") == 0
    return flat.withColumns({c: F.when(~none, F.col(c)) for c in ("distinct", "quantiles")})


def store(df: DataFrame, part: Column, columns: list[str], path: str, **sizes: int) -> None:
    """Appends the sketches of parts that the table at ``path`` lacks."""
    from pyspark.errors import AnalysisException

    try:
        known = df.sparkSession.read.parquet(path).select("part").distinct()
        df = df.withColumn("_part", part.cast("string"))
        df = df.join(known, F.col("_part").eqNullSafe(F.col("part")), "left_anti")
        part = F.col("_part")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    build(df, part, columns, **sizes).write.mode("append").parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def merged(rows: DataFrame, quantiles: tuple[float, ...] = (0.5,)) -> DataFrame:
    """column, n, n_null, n_distinct, and q (array) of the union of the parts in ``rows``."""
    per = rows.groupBy("column").agg(F.sum("n").alias("n"), F.sum("n_null").alias("n_null"), F.hll_union_agg("distinct").alias("d"), F.kll_merge_agg_double("quantiles").alias("k"), F.count("quantiles").alias("some"))
    q = F.when(F.col("some") > 0, F.array(*[F.kll_sketch_get_quantile_double(F.col("k"), F.lit(float(x))) for x in quantiles]))
    return per.select("column", "n", "n_null", F.when(F.col("n") > 0, F.hll_sketch_estimate("d")).alias("n_distinct"), q.alias("q"))
