"""Join sides whose size is checked before they are sent to all executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes up to which a side is sent to all executors, as a hash table; beyond it, it is shuffled.
SMALL_BYTES = 64 << 20
#: Bytes of a row in a hash table besides its columns.
ROW_BYTES = 64


def small(df: DataFrame, width: int) -> DataFrame:
    """df, whose rows have columns of ``width`` bytes together, marked for broadcast if its hash table takes at most SMALL_BYTES."""
    most = SMALL_BYTES // (ROW_BYTES + 2 * width)
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
