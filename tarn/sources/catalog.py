"""Tolerant tables: CSV or Parquet under one base folder.

A missing file gives an empty frame of the declared schema.  CSV rows carry
``_ord``, their place in the file, because "first" always means file order.
"""

import atexit
import contextlib
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.schemas import FILES, NA_TOKENS, TABLES

ORD = "_ord"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header, quoted multi-line fields, doubled quotes, BOM; all strings; NA tokens are null."""
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False)
    cols = [F.when(~F.col(f"`{c}`").isin(*NA_TOKENS), F.col(f"`{c}`")).alias(c) for c in raw.columns]
    return raw.select(*cols, F.monotonically_increasing_id().alias(ORD))


def read_binary_base64(spark: SparkSession, path: str) -> DataFrame:
    """Path and base64 of each file; a missing path gives no rows."""
    try:
        return spark.read.format("binaryFile").load(path).select("path", F.base64("content").alias("content_base64"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, content_base64 string")


class Catalog:
    """Lazy tables by name."""

    def __init__(self, spark: SparkSession, base: str, files: dict[str, str] | None = None):
        self.spark, self.base, self.files = spark, base.rstrip("/"), files or FILES

    def empty(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([], TABLES[name]).withColumn(ORD, F.lit(0).cast("long"))

    def table(self, name: str) -> DataFrame:
        path = f"{self.base}/{self.files[name]}"
        try:
            if path.endswith(".csv"):
                return read_csv(self.spark, path)
            return self.spark.read.parquet(path).withColumn(ORD, F.monotonically_increasing_id())
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.empty(name)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a temporary one, on a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tarn-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, wherever it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        if not spark.sparkContext._jsc.sc().isStopped():
            remove(spark, path)


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below ``shared_folder``, deleted when the program ends."""
    path = f"{shared_folder(spark)}/tarn-{uuid.uuid4().hex}"
    atexit.register(_remove_at_exit, spark, path)
    return path


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
