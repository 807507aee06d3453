"""The corpus pipeline: five stages over ``documents``, each written and read again."""

from pyspark.sql import DataFrame, SparkSession

from tarn.llm.ngram_join import deduplicated as one_of_each_group
from tarn.llm.packing import packed
from tarn.llm.pii import redacted
from tarn.llm.quality_rules import filtered
from tarn.llm.shared import dropped, saved
from tarn.llm.suffix_dedup import cleaned


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned list rejects go.

    Null and empty texts have no words, so they go; repeated rows go or stay together; without labels the base rule alone decides.
    """
    return filtered(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays: that of the smallest id, with its repeated rows.

    Texts without words link with nothing and stay; rows without an id are documents of their own by their text, after all others.
    """
    return one_of_each_group(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes in passages of 100 bytes that occur earlier are cut out.

    Rows whose text ends up empty, or was null, go; texts under 100 bytes stay whole; a character that loses a byte goes whole.
    """
    return cleaned(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind.

    Null texts stay null; equal rows are redacted equally; rows without an id like any other.
    """
    return redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, in sequences.

    A null or empty text is one piece with the end token; repeated rows have pieces each; an empty table has none.
    """
    import public_tokenizers

    return packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: SQL cannot express the stages; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        done = saved(stage(spark, docs, sf_dir), name)
        dropped(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
