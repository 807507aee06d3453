"""Chat histories kept by a stream: one state for each conversation.

Messages (conv_id, at, role, content) get the turn after the conversation's last one; within a batch they go by time,
then user before assistant, then content.  The state is the next turn and the time of the last message, so it stays small however long a
conversation is; it lives in the stream's checkpoint, from which a restart goes on.  A conversation without messages for ``idle`` of event
time ends: its state goes, and a next message begins again at turn 0.  A group is one conversation's messages of one
batch, whose size the source bounds (``maxFilesPerTrigger``).

A row older than the watermark, or without a time, is late: it gets no turn and is counted (``sessions.Ended``).  Rows with a
null conv_id are a conversation of their own.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MESSAGES = "conv_id long, at timestamp, role string, content string"
TURNS = "conv_id long, turn long, role string, content string"


def read_messages(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """A stream of JSON files, so many in a batch, oldest first."""
    return spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", files).json(folder)


def turns(messages: DataFrame, idle: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """conv_id, turn, role, content of a stream of messages."""
    seconds = float(messages.sparkSession.sql(f"SELECT CAST(INTERVAL '0' SECOND + INTERVAL {idle} AS INTERVAL DAY TO SECOND) AS i").first()["i"].total_seconds())

    def numbered(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        new = [x for p in parts for x in zip(p["at"].tolist(), p["role"].tolist(), p["content"].tolist(), strict=True)]
        # lists: a conversation has few messages, for which a frame's own sorting takes longer than all else
        new.sort(key=lambda x: (x[0], x[1] != "user", x[2] is None, x[2] or ""))
        after, last = state.get if state.exists else (0, 0.0)
        out = []
        for at, *_ in new:
            now = at.timestamp()
            if after and now - last >= seconds:
                after = 0
            out.append(after)
            after, last = after + 1, max(last, now)
        state.update((after, last))
        state.setTimeoutTimestamp(max(int((last + seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"conv_id": pd.Series([key[0]] * len(new), dtype="object" if key[0] is None else "int64"), "turn": out, "role": [x[1] for x in new], "content": [x[2] for x in new]})

    timed = messages.withColumn("at", F.coalesce("at", F.lit(0).cast("timestamp"))).withWatermark("at", delay)
    return timed.groupBy("conv_id").applyInPandasWithState(numbered, TURNS, "turn long, last double", "append", GroupStateTimeout.EventTimeTimeout)
