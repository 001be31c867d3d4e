"""Frozen rules and scores on a streaming DataFrame.

Fitted rules, features of a single row, evidence and explanations are projections of the
row, so the batch functions work unchanged on a stream.  History features need all earlier
rows and stay a batch job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from riskloom.operators.explain import with_explanations
from riskloom.operators.rules import RuleBase, with_truth


def explain_stream(
    rows: DataFrame, base: RuleBase, *, activation: float = 0.6, top_k: int = 3,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Rule truths and explanations of every arriving row."""
    ready = prepare(rows) if prepare else rows
    return with_explanations(with_truth(ready, base), base, activation=activation, top_k=top_k)


def write_stream(rows: DataFrame, path: str, checkpoint: str, *, available_now: bool = True) -> StreamingQuery:
    """Append to Parquet; the checkpoint makes a restarted query continue where it stopped."""
    writer = rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)
