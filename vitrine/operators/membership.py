"""A filter of a batch's keys, applied at the scan of a large table.

Jobs that compare a batch with a stored table (is this e-mail held, which references may a new row meet) need only the
stored rows whose key occurs in the batch. A join on the key would shuffle the whole table to find them. Here the
batch's keys set bits in a bitmap, put together by a bitwise aggregate; the table meets the bitmap as a broadcast of at
most ``WORDS`` rows (1 MiB, whatever the batch holds) and only rows whose bit is set go on. A row may pass by
chance, so an exact join follows; none is lost. With a batch as large as the table every bit is set, and the
filter changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = 1 << 16
_BITS = 64


def possible(rows: DataFrame, column: str, keys: DataFrame, key_column: str) -> DataFrame:
    """The rows whose ``column`` may equal a ``key_column`` of ``keys`` (NULL keys and rows are left out)."""
    def slot(name: str):
        return F.pmod(F.xxhash64(F.col(name)), F.lit(WORDS * _BITS))
    words = (keys.filter(F.col(key_column).isNotNull()).select(slot(key_column).alias("__slot"))
             .groupBy(F.floor(F.col("__slot") / _BITS).alias("__word"))
             .agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(__slot % {_BITS} AS INT))")).alias("__bits")))
    tested = rows.filter(F.col(column).isNotNull()).withColumn("__slot", slot(column)).withColumn(
        "__word", F.floor(F.col("__slot") / _BITS))
    hit = F.expr(f"(shiftright(__bits, CAST(__slot % {_BITS} AS INT)) & 1L) = 1L")
    return tested.join(F.broadcast(words), "__word").filter(hit).select(*rows.columns)
