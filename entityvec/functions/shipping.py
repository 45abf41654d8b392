"""Broadcast of small driver-side objects, readable where this package is not installed."""

from typing import Any

from pyspark import Broadcast, cloudpickle
from pyspark.sql import SparkSession


def ship(spark: SparkSession, value: Any) -> Broadcast:
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def unpack(sent: Broadcast) -> Any:
    return cloudpickle.loads(sent.value)


def ship_arrays(spark: SparkSession, value: Any) -> Broadcast:
    """As :func:`ship`, with the bytes of arrays beside the value, for :func:`unpack_arrays`."""
    arrays = []
    head = cloudpickle.dumps(value, protocol=5, buffer_callback=arrays.append)
    return spark.sparkContext.broadcast((head, [a.raw().tobytes() for a in arrays]))


def unpack_arrays(sent: Broadcast) -> Any:
    """The value. Its arrays are read-only views of what was sent, so a worker holds them once."""
    head, arrays = sent.value
    return cloudpickle.loads(head, buffers=arrays)
