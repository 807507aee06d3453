"""Chunks whose ends the content sets, so that an edit moves only the chunks near it.

A rolling hash over the last WINDOW bytes is taken at every byte; where its upper bits are all 0 a chunk may end.  A chunk ends at the first such
place after ``least`` bytes, or after ``most``.  Equal stretches of two versions of a text therefore have equal chunks again after the
first common end, and ``changed`` finds those of a new version that no old one has, by digest.

Chunks are of bytes (UTF-8) and cover each byte once, in order.  Null or empty text has no chunk; rows of equal id have chunks each.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 32
LEAST, MEAN, MOST = 512, 2048, 8192  # bytes; a mean is a power of 2, counted beyond the least
CHUNKS = "no int, start long, length long, bytes binary"


def _values() -> np.ndarray:
    """A scattered 64-bit value for each byte."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


VALUES = _values()


def ends(data: bytes, least: int = LEAST, mean: int = MEAN, most: int = MOST) -> np.ndarray:
    """Where chunks end; the last end is that of the data."""
    h, width = VALUES[np.frombuffer(data, dtype=np.uint8)], 1
    while width < WINDOW:  # sums over twice as many bytes, each byte's value moved by its distance
        h = np.concatenate([h[:width], h[width:] + (h[:-width] << np.uint64(width))])
        width *= 2
    may = np.flatnonzero(h >> np.uint64(64 - mean.bit_length() + 1) == 0) + 1
    out, at = [], 0
    while at < len(data):
        k = int(np.searchsorted(may, at + least))
        end = min(int(may[k]) if k < len(may) else len(data), at + most, len(data))
        out.append(end)
        at = end
    return np.array(out, dtype=np.int64)


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **sizes: int) -> DataFrame:
    """id, no, start, length, bytes, digest of each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, no, start, parts = [], [], [], []
            for i, text in enumerate(b.column(1)):
                data, at = text.as_py(), 0
                for k, end in enumerate(ends(data, **sizes).tolist()):
                    rows.append(i)
                    no.append(k)
                    start.append(at)
                    parts.append(data[at:end])
                    at = end
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(no, pa.int32()), pa.array(start, pa.int64()), pa.array([len(p) for p in parts], pa.int64()), pa.array(parts, pa.binary())], names=[id_col, "no", "start", "length", "bytes"])

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(f"`{id_col}`").alias(id_col), F.encode(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "UTF-8").alias("text"))
    return texts.mapInArrow(run, f"`{id_col}` {kind}, {CHUNKS}").withColumn("digest", F.sha2("bytes", 256))


def changed(new: DataFrame, old: DataFrame) -> DataFrame:
    """Chunks of new versions whose content no old version has."""
    return new.join(old.select("digest").distinct(), "digest", "left_anti")


def joined(parts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, n_chunks, bytes: the texts put together again; a group is one text."""
    rows = F.array_sort(F.collect_list(F.struct("no", "bytes")))
    whole = F.unhex(F.array_join(F.transform(rows, lambda x: F.hex(x["bytes"])), ""))
    return parts.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_chunks"), whole.alias("bytes"))
