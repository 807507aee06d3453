"""Data-quality tier implied by the data: duplicates, missing values, distributions."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_count(df: DataFrame, column: str) -> DataFrame:
    """Rows beyond the first of each distinct value. Grouping on a digest keeps whole texts out of the shuffle."""
    per = df.where(F.col(column).isNotNull()).groupBy(F.sha2(F.col(column), 256).alias("h")).agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def missing(df: DataFrame, columns) -> DataFrame:
    """One row: for each column, how many values are null or empty."""
    return df.agg(*[F.count_if(F.col(c).isNull() | (F.col(c).cast("string") == "")).alias(f"missing_{c}") for c in columns])


def distribution(df: DataFrame, column: str) -> DataFrame:
    """(value, n), for a column of few values."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def distribution_text(df: DataFrame, column: str) -> DataFrame:
    """One row "k: n, k: n", most frequent first, ties by key; for low-cardinality columns."""
    per = distribution(df.where(F.col(column).isNotNull()), column)
    rows = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col("value").cast("string").alias("v"), F.col("n"))))
    return per.agg(F.array_join(F.transform(rows, lambda x: F.concat(x["v"], F.lit(": "), x["n"].cast("string"))), ", ").alias("distribution"))


def rows_added(df: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """One row: how many rows of ``df`` have a key that ``before`` lacks."""
    return df.join(before.select(key).distinct(), key, "left_anti").agg(F.count(F.lit(1)).alias("rows_added"))


def report(metrics: dict[str, tuple[DataFrame, str]], checked_at: str) -> DataFrame:
    """metric, value (text), note: each metric's frame has one row of one column; ``checked_at`` is the stamp of the check."""
    rows = [df.select(F.lit(name).alias("metric"), F.col(df.columns[0]).cast("string").alias("value"), F.lit(note).alias("note")) for name, (df, note) in metrics.items()]
    out = reduce(DataFrame.unionAll, rows)
    return out.unionAll(out.sparkSession.createDataFrame([("checked_at", checked_at, "stamp")], "metric string, value string, note string"))


def parse_distribution(text: Column) -> Column:
    return F.str_to_map(text, F.lit(", "), F.lit(": "))
