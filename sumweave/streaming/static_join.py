"""Aggregates over the join of a stream with static relations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from sumweave.operators.explicit import agg_over_join
from sumweave.plans.ir import Bail


def stream_aggregate(stream: DataFrame, statics: Mapping[str, DataFrame], on: Sequence[tuple[str, str]], group_by: Sequence[str] | Mapping[str, str], aggregates: Mapping[str, tuple[str, str | None]], name: str = "stream") -> DataFrame:
    """Running aggregates of a stream joined with static relations.

    The static relations become one row for each key before the stream meets them, so a record of the stream makes one row, however many
    partners it has, and state grows with the groups alone. Windows and watermarks are columns of the stream: set
    withWatermark and add the window as a column before. Static sides are read when the query starts.
    """
    if not stream.isStreaming:
        raise Bail("the relation isn't a stream")
    if any(s.isStreaming for s in statics.values()):
        raise Bail("joins of two streams are Spark's own")
    # a stream can't be condensed before the join: each record stands for itself
    return agg_over_join({name: stream, **statics}, on, group_by, aggregates, unique={name: [[]]}, root=name)
