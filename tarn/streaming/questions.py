"""Extension: route a stream of questions and append it to the history."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.operators.answers import route_col


def routed(questions: DataFrame) -> DataFrame:
    """Adds the route; stateless, so it works on a stream or a batch."""
    return questions.withColumn("route", route_col(F.col("question")))


def read_questions(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema("conv_id long, question string").json(folder)


def write_routed(stream: DataFrame, out: str, checkpoint: str):
    return routed(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
