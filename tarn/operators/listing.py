"""Counts, lists and group overviews."""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from tarn.functions.text import available, safe_text
from tarn.schemas import DEPARTMENTS, NO_SUMMARY
from tarn.sources.catalog import ORD

# The columns of the lists, in their order.
PEOPLE = ("dept_name", "name", "role", "research_area", "homepage", "source_url")
COURSES = ("dept_name", "course_level", "course_code", "course_name", "course_type", "credit", "source_url")


def head(df: DataFrame, n: int, ord_col: str = ORD) -> DataFrame:
    """The first n rows in file order."""
    return df.orderBy(F.asc(ord_col)).limit(n)


def representative(df: DataFrame, wanted, limit: int, ord_col: str = ORD) -> DataFrame:
    """The first rows, with the wanted columns that exist, nulls as empty text."""
    cols = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in available(df, wanted)]
    return head(df, limit, ord_col).select(*cols)


def representative_people(df: DataFrame, limit: int = 9, ord_col: str = ORD) -> DataFrame:
    return representative(df, PEOPLE, limit, ord_col)


def representative_courses(df: DataFrame, limit: int = 10, ord_col: str = ORD) -> DataFrame:
    return representative(df, COURSES, limit, ord_col)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(metric, value) for each table."""
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(n).alias("metric"), "value") for n, df in tables.items()])


def labels(spark: SparkSession, rows=DEPARTMENTS) -> DataFrame:
    return spark.createDataFrame([(i, c, n) for i, (c, n) in enumerate(rows)], "label_ord int, dept string, dept_name string")


def first_urls(assets: DataFrame, ord_col: str = ORD) -> DataFrame:
    """dept, source_url: the first that isn't null, in file order."""
    kept = assets.where(F.col("source_url").isNotNull())
    return kept.groupBy("dept").agg(safe_text(F.min_by("source_url", ord_col)).alias("source_url"))


def first_texts(assets: DataFrame, n: int = 3, cut: int = 500, ord_col: str = ORD) -> DataFrame:
    """dept, summary: the first n texts that aren't null, joined by a space and cut."""
    rk = F.row_number().over(Window.partitionBy("dept").orderBy("o"))
    rows = assets.where(F.col("text").isNotNull()).select("dept", "text", F.col(ord_col).alias("o"))
    # places are ranked without their texts, so no task sorts or holds these; n rows a group find them again
    first = rows.select("dept", "o").withColumn("rn", rk).where(F.col("rn") <= n).select(F.col("dept").alias("d"), F.col("o").alias("at")).distinct()
    top = rows.join(F.broadcast(first), F.col("dept").eqNullSafe(F.col("d")) & F.col("o").eqNullSafe(F.col("at"))).select("dept", "text", "o").withColumn("rn", rk).where(F.col("rn") <= n)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rn", "text"))), lambda x: x["text"])
    return top.groupBy("dept").agg(F.substring(F.array_join(parts, " "), 1, cut).alias("summary"))


def group_overview(label_rows: DataFrame, assets: DataFrame, placeholder: str | Column = NO_SUMMARY, ord_col: str = ORD) -> DataFrame:
    """A row for each label, also without assets. Facts shrink to a row a group before the join."""
    known = label_rows.select("dept")
    small = assets.join(F.broadcast(known), "dept", "left_semi")  # labels are a row a group of the overview; assets must not be dealt out by group
    out = label_rows
    out = out.join(first_texts(small, ord_col=ord_col), "dept", "left") if "text" in assets.columns else out.withColumn("summary", F.lit(None).cast("string"))
    out = out.join(first_urls(small, ord_col), "dept", "left") if "source_url" in assets.columns else out.withColumn("source_url", F.lit(None).cast("string"))
    return out.select("label_ord", "dept", "dept_name", F.coalesce("summary", F.lit(placeholder)).alias("summary"), F.coalesce("source_url", F.lit("")).alias("source_url"))


def departments(spark: SparkSession, assets: DataFrame, ord_col: str = ORD) -> DataFrame:
    """The overview for the built-in labels; without any asset or dept column, the fixed summaries."""
    from tarn.schemas import FALLBACK_SUMMARIES

    fixed = labels(spark).select("label_ord", "dept", "dept_name", F.create_map(*[F.lit(x) for kv in FALLBACK_SUMMARIES.items() for x in kv])[F.col("dept")].alias("summary"), F.lit("").alias("source_url"))
    if "dept" not in assets.columns:
        return fixed
    some = assets.limit(1).agg((F.count(F.lit(1)) > 0).alias("some"))
    both = group_overview(labels(spark), assets, ord_col=ord_col).withColumn("real", F.lit(True)).unionByName(fixed.withColumn("real", F.lit(False)))
    return both.join(F.broadcast(some), F.col("real") == F.col("some")).drop("real", "some")  # one row
