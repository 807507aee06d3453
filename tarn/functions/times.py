"""Times as numbers."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, FractionalType, TimestampNTZType, TimestampType

MICROS = 1_000_000


def is_time(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, DateType | TimestampNTZType | TimestampType)


def ticks(df: DataFrame, name: str) -> Column:
    """A column as numbers in its order: dates and timestamps in microseconds, whole numbers as they are, others as doubles."""
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, DateType | TimestampNTZType | TimestampType):
        return F.unix_micros(c.cast("timestamp"))
    return c.cast("double" if isinstance(kind, FractionalType) else "long")
