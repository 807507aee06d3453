"""What several operators need: shared tables and connected components."""

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.sources.catalog import remove, shared_folder

ID_BITS, MAX_BITS = 16, 1 << 27  # of the filter of wanted ids: for each id, and at most


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes the frame to the shared folder and reads it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tarn-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tarn_path = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Deletes tables made by ``saved`` that no later step reads."""
    for df in frames:
        if path := getattr(df, "_tarn_path", None):
            remove(df.sparkSession, path)


def give_back() -> None:
    """Returns what a Python worker no longer uses to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def text_or_empty(c="text") -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def row_key(id_: Column, text="text") -> Column:
    """The id; for a row without one, a number from 2^62 on that only rows of equal text share, so each such text is a document of its own."""
    own = F.shiftrightunsigned(F.xxhash64(text_or_empty(text)), 2).bitwiseOR(F.lit(1 << 62))
    return F.coalesce(id_, own)


def _places(h: np.ndarray, bits: int) -> list[np.ndarray]:
    u = h.astype(np.int64).view(np.uint64)
    return [(x & np.uint64(bits - 1)).astype(np.int64) for x in (u, u >> np.uint64(32))]


def among_hashes(wanted: DataFrame, hashed: Column | None = None) -> Callable[[np.ndarray], np.ndarray]:
    """Tells inside a task which of some ids' xxhash64 may be those of wanted ones (id), by a Bloom filter of at most MAX_BITS.

    ``hashed`` gives the hash where it is not xxhash64 of the id. A full filter says so of more ids, never of fewer.
    """
    bits, n = 64, wanted.count()
    while bits < min(ID_BITS * n, MAX_BITS):
        bits *= 2
    h = F.xxhash64("id") if hashed is None else hashed
    place = F.explode(F.array(h.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(bits - 1)))).alias("at")
    words = wanted.select(place).groupBy(F.shiftright("at", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 31 as int))")).alias("set")).toArrow()
    table = np.zeros(bits // 32, dtype=np.uint32)
    table[words.column("word").to_numpy()] = words.column("set").to_numpy().astype(np.uint32)
    table = wanted.sparkSession.sparkContext.broadcast(table)

    def may(h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), dtype=bool)
        for at in _places(h, bits):
            out &= (table.value[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1) == 1
        return out

    return may


def among(may: Callable[[np.ndarray], np.ndarray]) -> Callable[[Column], Column]:
    """The test of ``among_hashes`` as a condition on a column of ids."""

    @F.pandas_udf("boolean")
    def of(h: pd.Series) -> pd.Series:
        return pd.Series(may(h.to_numpy()))

    return lambda id_: of(F.xxhash64(id_))


def in_parts(column: pa.Array, size: int) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of slices of about ``size`` bytes; a batch is never a list as a whole."""
    data = column.cast(pa.binary())
    ends = np.cumsum(pc.binary_length(data).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(data):
        last = min(len(data), int(np.searchsorted(ends, (ends[first - 1] if first else 0) + size)) + 1)
        yield first, data.slice(first, last - first).to_pylist()
        first = last


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) of every id in the edges (a, b); component is the smallest id reachable.

    Alternating large-star and small-star rounds; each round is written to the
    shared folder.  A hub's edges meet only in sort-merge joins, which adaptive
    execution splits, and in aggregates with a map-side part.  Nothing is collected.
    Ids without an edge, or only with one to themselves, do not appear.
    """
    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("c"), F.lit(0).alias("p")).unionAll(now.select("v", F.lit(0), F.lit(1)))
        bad = ends.groupBy("x").agg(F.sum("c").alias("c"), F.sum("p").alias("p")).where("c > 1 or (c > 0 and p > 0)")
        if bad.limit(1).count() == 0:
            ids = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
            return ids.unionAll(now.select("v", "v").distinct())
        both = now.unionAll(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least.select(F.col("u"), F.least("u", "m").alias("m")), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        new = saved(small, "edges")
        dropped(now)
        now = new
    raise RuntimeError("components did not settle")
