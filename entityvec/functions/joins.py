"""Join sides whose size is looked up before they are sent to every task."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000


def sent_if_small(keys: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a narrow key table for broadcast if it has at most ``max_rows`` rows.

    Worth a job where the other side is wide: adaptive execution would find out too, but
    only after it has started to shuffle that side.
    """
    if keys.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(keys)
    return keys
