"""Ordered folds and time keys that the stateful operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SECOND = 1_000_000


def micros(ts: str = "ts") -> Column:
    """Epoch microseconds at face value, whatever the session's time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))")


def with_value(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """Add ``name`` and keep the rows that have it. A filter would be pushed below and work the value out twice."""
    return rows.select("*", F.explode(F.array_compact(F.array(value))).alias(name))


#: Lengths of a block of time, in spans: one in so many rows is read in two blocks.
SPANS_A_BLOCK = 8


def time_blocks(rows: DataFrame, span: int) -> DataFrame:
    """Add ``_block`` and ``_own``: each row in its block of time, and once more, not its own, in the next one where that begins
    less than ``span`` seconds after it. What looks back less than ``span`` seconds can be worked out in each block alone."""
    length = SPANS_A_BLOCK * span * SECOND
    block = F.expr(f"us div {length} - if(us % {length} < 0, 1, 0)")
    # its own block, and that of the moment at which it stops to count
    until = F.expr(f"(us + {span * SECOND - 1}) div {length} - if((us + {span * SECOND - 1}) % {length} < 0, 1, 0)")
    return rows.withColumn("_block", F.explode(F.sequence(block, until))).withColumn("_own", F.col("_block") == block)


def ordered_fold(rows: DataFrame, keys: list[str], order: list[str], start: Callable[[], object], step: Callable[[object, tuple], list[tuple]], schema: str) -> DataFrame:
    """Run ``step(state, row)`` over each key's rows in order, and return all rows it gives.

    A key's rows stream through one task in sorted batches, so memory holds the state alone, however
    many rows the key has. ``row`` has the columns in the order of ``rows``; ``start`` makes a key's state.
    """
    at = [rows.columns.index(k) for k in keys]
    names = T.StructType.fromDDL(schema).fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            out: list[tuple] = []
            for row in batch.itertuples(index=False, name=None):
                mine = tuple(row[k] for k in at)
                if state is None or mine != key:
                    key, state = mine, start()
                out.extend(step(state, row))
            yield pd.DataFrame.from_records(out, columns=names)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
