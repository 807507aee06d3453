"""Chat history as an append-only table keyed by (conv_id, turn)."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.schemas import GREETING, MESSAGE, ORG, PRESETS, RESET_GREETING


def seed(spark: SparkSession, conv_id: int, reset: bool = False, org: str = ORG) -> DataFrame:
    """A history of one greeting."""
    return spark.createDataFrame([(conv_id, 0, "assistant", RESET_GREETING if reset else GREETING.format(org=org), [])], MESSAGE)


def seeded(history: DataFrame, reset: bool = False, org: str = ORG) -> DataFrame:
    """A history of one greeting for each conversation in ``history``."""
    text = RESET_GREETING if reset else GREETING.format(org=org)
    return history.select("conv_id").distinct().select("conv_id", F.lit(0).cast("long").alias("turn"), F.lit("assistant").alias("role"), F.lit(text).alias("content"), F.array().cast(MESSAGE["sources"].dataType).alias("sources"))


def presets(spark: SparkSession, org: str = ORG) -> DataFrame:
    """preset, question: the questions offered as buttons."""
    return spark.createDataFrame([(i, q.format(org=org)) for i, q in enumerate(PRESETS, 1)], "preset long, question string")


def append(history: DataFrame, conv_id: int, question: str, reply: DataFrame) -> DataFrame:
    """History plus the user's turn and the assistant's; ``reply`` is one row (answer, sources)."""
    last = history.where(F.col("conv_id") == conv_id).agg(F.coalesce(F.max("turn"), F.lit(-1)).alias("t"))
    none = F.array().cast(MESSAGE["sources"].dataType)
    asked = last.select(F.lit(conv_id).cast("long").alias("conv_id"), (F.col("t") + 1).alias("turn"), F.lit("user").alias("role"), F.lit(question).alias("content"), none.alias("sources"))
    one = reply.agg(F.first("answer").alias("content"), F.first("sources").alias("sources")).withColumn("conv_id", F.lit(conv_id).cast("long"))
    said = last.withColumn("conv_id", F.lit(conv_id).cast("long")).join(one, "conv_id").select("conv_id", (F.col("t") + 2).alias("turn"), F.lit("assistant").alias("role"), "content", "sources")
    return history.unionByName(asked).unionByName(said)


def append_turns(history: DataFrame, new: DataFrame) -> DataFrame:
    """Batch form: new (conv_id, role, content, k) rows follow each conversation's last turn; k orders them from 1."""
    last = history.groupBy("conv_id").agg(F.max("turn").alias("t"))
    fresh = new.join(last, "conv_id", "left").select("conv_id", (F.coalesce("t", F.lit(-1)) + F.col("k")).alias("turn"), "role", "content")
    return history.select("conv_id", "turn", "role", "content").unionByName(fresh)


def replay(history: DataFrame) -> DataFrame:
    return history.orderBy("conv_id", "turn")
