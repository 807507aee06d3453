"""Keyword search with deterministic order."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.text import first_existing, hits, safe_text, tokens, tokens_col
from tarn.operators.keyword_tables import scored
from tarn.sources.catalog import ORD


def chunks(df: DataFrame, ord_col: str = ORD) -> DataFrame:
    """Search columns of a chunk table: ord, title, dept_name, text, source_url."""
    return df.select(
        F.col(ord_col).alias("ord"),
        safe_text(first_existing(df, ("title", "document_title"))).alias("title"),
        safe_text(first_existing(df, ("dept_name", "dept"))).alias("dept_name"),
        safe_text(first_existing(df, ("chunk_text", "text"))).alias("text"),
        safe_text(first_existing(df, ("source_url",))).alias("source_url"),
    )


def combined() -> Column:
    """What the search looks in."""
    return F.lower(F.concat(F.col("title"), F.lit(" "), F.col("text")))


def all_hits(found: DataFrame, query: str) -> DataFrame:
    """Every chunk with a score above 0; a query without tokens hits nothing."""
    words = tokens(query)
    out = found.select(hits(combined(), words).alias("score"), "*")
    return out.where(F.col("score") > 0) if words else out.where(F.lit(False))


def search(found: DataFrame, query: str, limit: int = 3) -> DataFrame:
    """The best hits; ties in file order. One scan, then a top-k for each partition."""
    return all_hits(found, query).orderBy(F.desc("score"), F.asc("ord")).limit(limit)


def search_many(questions: DataFrame, found: DataFrame, limit: int = 3) -> DataFrame:
    """Top hits for each question (q_id, question), as an extension.

    Chunks are read once for all tokens, and scores are added up block by block (``keyword_tables.scored``). Repeats of a token count.
    """
    toks = questions.select("q_id", F.explode(tokens_col(F.col("question"))).alias("w")).groupBy("q_id", "w").agg(F.count("*").alias("n"))
    best = scored(toks, found.select("ord", combined().alias("text")), limit)
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("score"), F.asc("ord")))
    return best.withColumn("rk", rank).where(F.col("rk") <= limit).join(found, "ord").select("q_id", "rk", "score", *found.columns)
