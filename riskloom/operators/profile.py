"""Profiles of a table: missing values, sentinels, label rates over time, seeds and gaps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.ranks import with_global_rank
from riskloom.session import stage


def missingness(df: DataFrame, columns: Sequence[str], sentinels: Mapping[str, float] | None = None) -> DataFrame:
    """Native missing cells and sentinel cells of every column, in one aggregate."""
    sentinels = sentinels or {}
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def absent(c: str) -> Column:
        null = F.col(c).isNull()
        return null | F.isnan(c) if kinds[c] in ("double", "float") else null

    aggregates = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        aggregates.append(F.count_if(absent(c)).alias(f"m{i}"))
        hit = F.col(c).cast("double") == F.lit(float(sentinels[c])) if c in sentinels else F.lit(False)
        aggregates.append(F.count_if(hit).alias(f"s{i}"))
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing_cells"), F.col(f"s{i}").alias("sentinel_cells"))
            for i, c in enumerate(columns)
        ]
    )
    long = df.agg(*aggregates).select("rows", F.explode(pairs).alias("e")).select("rows", "e.*")
    return long.withColumns(
        {
            "missing_rate": F.when(F.col("rows") > 0, F.col("missing_cells") / F.col("rows")),
            "sentinel_rate": F.when(F.col("rows") > 0, F.col("sentinel_cells") / F.col("rows")),
        }
    )


def exact_duplicates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows beyond the first of each group of equal rows."""
    names = list(columns or df.columns)
    groups = df.groupBy(*names).agg(F.count(F.lit(1)).alias("__n"))
    return groups.agg(
        F.sum("__n").alias("rows"), F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_rows")
    )


def rate_by_group(df: DataFrame, group: Column, label: str, name: str = "period") -> DataFrame:
    return df.groupBy(group.alias(name)).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(label).cast("bigint").alias("positives"),
        F.avg(F.col(label).cast("double")).alias("positive_rate"),
    )


def rate_by_time_bin(df: DataFrame, time: str, label: str, row_id: str, bins: int = 12) -> DataFrame:
    """Label rate in chronological bins of equal size, numbered from 1.

    Bin limits are the quantiles of the row positions; a limit belongs to the earlier bin.
    """
    slim = stage(df.select(row_id, label, F.unix_micros(F.col(time)).alias("__t"), F.col(time).alias("__time")), "rows")
    n = slim.count()
    k = min(bins, n)
    ranked = with_global_rank(slim, [("__t", "asc")], row_id, out="__rank")
    position = F.expr(f"((__rank - 1) * {k}L + {max(n - 2, 0)}L) div {max(n - 1, 1)}L")
    place = F.greatest(F.lit(1), position).cast("int")
    return ranked.groupBy(place.alias("time_bin")).agg(
        F.min("__time").alias("start_time"),
        F.max("__time").alias("end_time"),
        F.count(F.lit(1)).alias("rows"),
        F.sum(label).cast("bigint").alias("positives"),
        F.avg(F.col(label).cast("double")).alias("positive_rate"),
    )


def candidate_counts(registry: DataFrame) -> DataFrame:
    return registry.groupBy("tier", "source").agg(F.count(F.lit(1)).alias("candidates"))
