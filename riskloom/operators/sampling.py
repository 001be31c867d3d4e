"""Sampling operators whose limit is the feature: time-group quotas and systematic samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.ranks import null_safe_join, with_global_rank
from riskloom.session import small, stage


def group_quota_sample(df: DataFrame, group: str, max_rows: int, *, row_id: str, seed: int = 42) -> DataFrame:
    """At most ``max_rows`` rows, spread evenly over the groups; no group is dropped.

    The first ``max_rows mod groups`` groups in order get one row more.  Rows are taken by
    seeded digest.  Rows without a group are a group of their own, the first in order.
    """
    rows = stage(df.withColumn("__id", F.concat_ws("|", F.lit(str(seed)), F.col(row_id).cast("string"))), "rows")
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    facts = sizes.agg(F.count(F.lit(1)).alias("g")).first()
    total, groups = rows.count(), int(facts["g"])
    if not groups or total <= max_rows:
        return rows.drop("__id")
    base, rest = divmod(max_rows, groups)
    # One row per group.
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(group)) - 1
    quotas = sizes.select(group, F.when(place < rest, base + 1).otherwise(base).alias("__quota"))
    ranked = with_global_rank(rows, [], "__id", partition=[group], out="__rank")
    return null_safe_join(ranked, small(quotas), [group]).filter(F.col("__rank") <= F.col("__quota")).drop("__id", "__rank", "__quota")


def systematic_positions(n: int, k: int) -> list[int]:
    """Zero-based evenly spaced rows that include the first and the last."""
    if k < 2:
        raise ValueError("at least two rows are needed to keep both ends")
    return [i * (n - 1) // (k - 1) for i in range(k)]


def systematic_sample(df: DataFrame, max_rows: int, *, time: str, row_id: str) -> DataFrame:
    """Every (n-1)/(k-1)-th row by time, both ends included."""
    if max_rows < 2:
        raise ValueError("at least two rows are needed to keep both ends")
    rows = stage(df.withColumn("__t", F.unix_micros(F.col(time))), "rows")
    n = rows.count()
    if n <= max_rows:
        return rows.drop("__t")
    ranked = with_global_rank(rows, [("__t", "asc")], row_id, out="__rank")
    # Row r is taken when r = floor(i (n-1) / (k-1)) for i = ceil(r (k-1) / (n-1)), in whole numbers.
    ranked = ranked.withColumn("__i", F.expr(f"((__rank - 1) * {max_rows - 1}L + {n - 2}L) div {n - 1}L"))
    taken = F.expr(f"(__i * {n - 1}L) div {max_rows - 1}L = __rank - 1")
    return ranked.filter(taken).drop("__t", "__rank", "__i")
