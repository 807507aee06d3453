"""Event-time sessions on a stream, with late rows counted.

A session of a key is a run of events with less than ``gap`` between neighbours.  The watermark follows the latest event by
``delay``: a session is final, and written, once the watermark has passed its end, and its state goes then. A row older than the
watermark is late: it changes nothing and is counted.  Rows with a null key form sessions of their own, rows with a null time none.

``sessions`` works on a batch too and gives all sessions there; a finished stream has those that ended before its last watermark.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str, time: str, value: str, gap: str, delay: str) -> DataFrame:
    """key, start, end (of the last event plus the gap), n, total."""
    timed = events.where(F.col(time).isNotNull())
    if events.isStreaming:
        timed = timed.withWatermark(time, delay)
    per = timed.groupBy(F.session_window(time, gap).alias("session"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return per.select(key, F.col("session.start").alias("start"), F.col("session.end").alias("end"), "n", "total")


@dataclass
class Ended:
    """What a run of a stream tells: rows read, late rows left out, and the last watermark (text, as Spark gives it)."""

    rows: int
    late: int
    watermark: str | None


def run(stream: DataFrame, out: str, checkpoint: str) -> Ended:
    """Runs a stream over all that is there now, to Parquet files; a later run with the same checkpoint goes on from there."""
    q = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    told = [p.json if isinstance(p.json, dict) else __import__("json").loads(p.json) for p in q.recentProgress]
    late = sum(int(op.get("numRowsDroppedByWatermark", 0)) for p in told for op in p.get("stateOperators", []))
    marks = [p["eventTime"]["watermark"] for p in told if p.get("eventTime", {}).get("watermark")]
    return Ended(sum(int(p.get("numInputRows", 0)) for p in told), late, max(marks, default=None))
