"""Per-key aggregation whose work does not follow the skew of the keys.

Rows are cut into chunks of a fixed number of rows. Each chunk is combined where it is read, into one state per key
and chunk. The states then meet in rounds: in a round at most ``fan_in`` neighbouring chunks of a key are merged, so no
task ever receives all partial states of a hot key, and the number of rounds grows with the logarithm of the input.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a chunk, and chunks merged into one in a round.
CHUNK_ROWS = 1 << 16
FAN_IN = 32


@dataclass(frozen=True)
class State:
    """An aggregate that can be merged: how a row enters a state and how two states become one."""

    name: str
    start: Column
    merge: str = "sum"

    def merged(self) -> Column:
        return {"sum": F.sum, "min": F.min, "max": F.max, "sketch": F.hll_union_agg}[self.merge](F.col(f"`{self.name}`")).alias(self.name)


def count_rows(name: str) -> State:
    return State(name, F.count(F.lit(1)).alias(name))


def total(name: str, value: Column) -> State:
    """Sum over the non-null values; 0 where there is none."""
    return State(name, F.coalesce(F.sum(value), F.lit(0)).alias(name))


def least(name: str, value: Column) -> State:
    return State(name, F.min(value).alias(name), "min")


def greatest(name: str, value: Column) -> State:
    return State(name, F.max(value).alias(name), "max")


def distinct_sketch(name: str, value: Column) -> State:
    """HyperLogLog sketch of fixed size; read it with ``hll_sketch_estimate``."""
    return State(name, F.hll_sketch_agg(value).alias(name), "sketch")


def tree_rounds(rows: int, chunk_rows: int = CHUNK_ROWS, fan_in: int = FAN_IN) -> int:
    """Rounds until the chunks of ``rows`` rows meet in one."""
    chunks = max(2, math.ceil(rows / chunk_rows))
    return max(1, math.ceil(math.log(chunks, fan_in)))


def _expected_rows(df: DataFrame, bytes_per_row: int = 4) -> int:
    """Rows by the size that the optimizer expects; no job runs. It decides on the number of rounds only."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // bytes_per_row


def tree_aggregate(df: DataFrame, key: str, states: Sequence[State], rows: int | None = None, chunk_rows: int = CHUNK_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """One row per value of ``key`` (null is a value of its own) with the merged states.

    ``rows`` is the number of input rows, if it is known; it sets the number of rounds only. An empty input gives no
    rows. Repeated rows count each. Columns of ``df`` that no state uses are never read. Every chunk takes one of
    ``fan_in ** rounds`` places by a hash of its number, and a round merges ``fan_in`` neighbouring places.
    """
    rounds = min(6, tree_rounds(_expected_rows(df) if rows is None else rows, chunk_rows, fan_in))
    place = F.monotonically_increasing_id()
    part, nth = F.shiftright(place, 33), place.bitwiseAND(F.lit((1 << 33) - 1))
    chunk = F.pmod(F.xxhash64(part, F.floor(nth / F.lit(chunk_rows))), F.lit(fan_in**rounds)).cast("long")
    out = df.withColumn("__chunk", chunk).groupBy(F.col(key).alias("__key"), "__chunk").agg(*[s.start for s in states])
    for left in range(rounds - 1, -1, -1):
        by: list[str | Column] = ["__key"]
        if left:
            by.append(F.floor(F.col("__chunk") / F.lit(fan_in)).cast("long").alias("__chunk"))
        out = out.groupBy(*by).agg(*[s.merged() for s in states])
    return out.withColumnRenamed("__key", key)
