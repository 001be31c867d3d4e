"""Leakage-safe partitions and their summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.ranks import null_safe_join, prefix_sums, with_global_rank
from riskloom.session import small, stage

VALIDATION_ROLES = ("calibration_fit", "calibration_select", "rule_audit", "policy_select")
ROLES = ("train", *VALIDATION_ROLES, "test")


def _check_sizes(sizes: Sequence[float]) -> None:
    if abs(sum(sizes) - 1.0) > 1e-8:
        raise ValueError(f"split sizes must sum to 1, got {list(sizes)}")
    if min(sizes) <= 0:
        raise ValueError(f"split sizes must be positive, got {list(sizes)}")


# --- timestamp-safe split -------------------------------------------------------------------


@dataclass(frozen=True)
class TemporalCuts:
    """First timestamps of each later part, as microseconds, with the rows before them."""

    starts: tuple[int, ...]
    rows_before: tuple[int, ...]
    rows: int

    def role(self, time: Column) -> Column:
        micros = F.unix_micros(time)
        label = F.lit(ROLES[-1])
        for name, start in reversed(list(zip(ROLES, self.starts))):
            label = F.when(micros < start, F.lit(name)).otherwise(label)
        return label


    def within(self, time: Column, roles: Sequence[str]) -> Column:
        """Time ranges of the given roles; as plain comparisons they reach the file scan."""
        edges = [None, *self.starts, None]
        condition = F.lit(False)
        for place, name in enumerate(ROLES):
            if name in roles:
                low, high = edges[place], edges[place + 1]
                inside = F.lit(True) if low is None else time >= F.timestamp_micros(F.lit(low))
                if high is not None:
                    inside = inside & (time < F.timestamp_micros(F.lit(high)))
                condition = condition | inside
        return condition


def timestamp_safe_cuts(
    df: DataFrame,
    sizes: tuple[float, float, float] = (0.6, 0.2, 0.2),
    *,
    time: str = "event_time",
) -> TemporalCuts:
    """Cut the time axis between distinct timestamps, nearest to the requested row counts.

    Validation is cut again into four chronological roles.
    """
    _check_sizes(sizes)
    cells = stage(
        df.groupBy(F.unix_micros(F.col(time)).alias("t")).agg(F.count(F.lit(1)).alias("n")), "time-cells"
    )
    facts = cells.agg(F.sum("n").alias("n"), F.count_if(F.col("t").isNull()).alias("bad")).first()
    if facts["bad"]:
        raise ValueError(f"{time} contains missing timestamps")
    n = int(facts["n"] or 0)
    if n < 40:
        raise ValueError("at least 40 rows are required for eight temporal partitions")
    before = prefix_sums(cells, "t", {"n": "n"}).select("t", F.col("n_before").alias("before"))
    before = stage(before, "time-prefix")

    def nearest(desired: int, lower: int, upper: int) -> tuple[int, int]:
        options = before.filter((F.col("before") >= lower) & (F.col("before") <= upper))
        best = options.agg(
            F.min(F.struct(F.abs(F.col("before") - desired).alias("d"), F.col("before"), F.col("t"))).alias("b")
        ).first()["b"]
        if best is None:
            raise ValueError("not enough distinct timestamps for leakage-safe partitions")
        return int(best["before"]), int(best["t"])

    train_rows, train_end = nearest(round(n * sizes[0]), 1, n - 2)
    valid_rows, valid_end = nearest(round(n * (sizes[0] + sizes[1])), train_rows + 1, n - 1)
    size = valid_rows - train_rows
    inner: list[tuple[int, int]] = []
    lower = 1
    for left, share in zip((3, 2, 1), (0.25, 0.5, 0.75)):
        rows, start = nearest(
            train_rows + round(size * share), train_rows + lower, train_rows + size - left
        )
        inner.append((rows, start))
        lower = rows - train_rows + 1
    marks = [(train_rows, train_end), *inner, (valid_rows, valid_end)]
    return TemporalCuts(tuple(t for _, t in marks), tuple(r for r, _ in marks), n)


def with_roles(df: DataFrame, cuts: TemporalCuts, *, time: str = "event_time") -> DataFrame:
    role = cuts.role(F.col(time))
    return df.withColumn("role", role).withColumn(
        "split", F.when(F.col("role").isin(*VALIDATION_ROLES), "validation").otherwise(F.col("role"))
    )


# --- splits by row share --------------------------------------------------------------------


def _share_label(rank: Column, ends: Sequence[tuple[str, Column | int]], last: str) -> Column:
    label = F.lit(last)
    for name, end in reversed(ends):
        label = F.when(rank <= end, F.lit(name)).otherwise(label)
    return label


def temporal_rows_split(
    df: DataFrame, sizes: tuple[float, float, float], *, time: str, row_id: str, out: str = "split"
) -> DataFrame:
    """First rows by time train, then validation, then test; equal times may straddle a cut."""
    _check_sizes(sizes)
    rows = stage(df.withColumn("__t", F.unix_micros(F.col(time))), "rows")
    n = rows.count()
    ends = [("train", int(n * sizes[0])), ("validation", int(n * (sizes[0] + sizes[1])))]
    ranked = with_global_rank(rows, [("__t", "asc")], row_id, out="__rank")
    return ranked.withColumn(out, _share_label(F.col("__rank"), ends, "test")).drop("__t", "__rank")


def chronological_thirds(
    df: DataFrame, fractions: tuple[float, float, float] = (0.4, 0.3, 0.3), *, time: str, row_id: str
) -> DataFrame:
    """Calibrator-fit, calibrator-selection and threshold-selection rows of a validation table."""
    _check_sizes(fractions)
    rows = stage(df.withColumn("__t", F.unix_micros(F.col(time))), "rows")
    n = rows.count()
    if n < 6:
        raise ValueError("at least six validation rows are required")
    first = max(2, int(n * fractions[0]))
    second = min(max(first + 2, int(n * (fractions[0] + fractions[1]))), n - 2)
    ranked = with_global_rank(rows, [("__t", "asc")], row_id, out="__rank")
    ends = [("calibrator_fit", first), ("calibrator_selection", second)]
    return ranked.withColumn(
        "partition", _share_label(F.col("__rank"), ends, "threshold_selection")
    ).drop("__t", "__rank")


def chronological_halves(df: DataFrame, fit_fraction: float = 0.5, *, time: str, row_id: str) -> DataFrame:
    """Earlier rows fit a calibrator, later rows select it."""
    rows = stage(df.withColumn("__t", F.unix_micros(F.col(time))), "rows")
    n = rows.count()
    cut = min(max(int(n * fit_fraction), 2), n - 2)
    ranked = with_global_rank(rows, [("__t", "asc")], row_id, out="__rank")
    return ranked.withColumn("partition", _share_label(F.col("__rank"), [("fit", cut)], "select")).drop(
        "__t", "__rank"
    )


def time_group_split(df: DataFrame, groups: Mapping[str, Sequence] | DataFrame, *, time: str) -> DataFrame:
    """Assign whole time groups to splits; absent or unassigned groups are an error.

    ``groups`` maps each split to its groups, or is a table (``time`` column, split).
    A row without a time is in no assigned group, hence an error as well.
    """
    kind = df.schema[time].dataType.simpleString()
    if isinstance(groups, DataFrame):
        assigned = groups.select(F.col(time).cast(kind).alias(time), "split")
    else:
        pairs = [(g, name) for name, values in groups.items() for g in values]
        assigned = df.sparkSession.createDataFrame(pairs, f"`{time}` {kind}, split string")
    named = {r["split"] for r in assigned.select("split").distinct().collect()}
    if not {"train", "validation", "test"} <= named:
        raise ValueError("train, validation and test groups must all be given")
    if not assigned.groupBy(time).count().where("count > 1").isEmpty():
        raise ValueError("time groups must be disjoint")
    observed = df.select(time).distinct()
    unassigned = observed.join(assigned, time, "left_anti").limit(5).collect()
    if unassigned:
        raise ValueError(f"observed time groups are unassigned: {[r[0] for r in unassigned]}")
    missing = assigned.join(observed, time, "left_anti").limit(5).collect()
    if missing:
        raise ValueError(f"configured time groups are absent from the data: {[r[0] for r in missing]}")
    return df.join(small(assigned), time)


def stratified_split(
    df: DataFrame,
    sizes: tuple[float, float, float],
    *,
    target: str,
    row_id: str,
    seed: int = 42,
    out: str = "split",
) -> DataFrame:
    """Random split with exact per-class shares: rows are ordered by a seeded digest.

    Rows without a class are a class of their own.
    """
    _check_sizes(sizes)
    rows = stage(df.withColumn("__id", F.concat_ws("|", F.lit(str(seed)), F.col(row_id).cast("string"))), "rows")
    sizes_by_class = rows.groupBy(target).agg(F.count(F.lit(1)).alias("__class_rows"))
    ranked = null_safe_join(with_global_rank(rows, [], "__id", partition=[target], out="__rank"), small(sizes_by_class), [target])
    first = F.floor(F.col("__class_rows") * F.lit(sizes[0]))
    second = F.floor(F.col("__class_rows") * F.lit(sizes[0] + sizes[1]))
    label = _share_label(F.col("__rank"), [("train", first), ("validation", second)], "test")
    return ranked.withColumn(out, label).drop("__id", "__rank", "__class_rows")


# --- summaries ------------------------------------------------------------------------------


def split_groups(df: DataFrame, *, time: str, split: str = "split") -> DataFrame:
    """One row per time group and split: its rows, and whether another split has the group, too."""
    cells = df.filter(F.col(time).isNotNull()).groupBy(F.col(time).alias("time_group"), split).agg(F.count(F.lit(1)).alias("rows"))
    alone = cells.groupBy("time_group").agg(F.count(F.lit(1)).alias("__splits"))
    return cells.join(alone, "time_group").select("time_group", split, "rows", (F.col("__splits") > 1).alias("shared"))


def split_integrity(df: DataFrame, *, time: str, split: str = "split") -> DataFrame:
    """Rows, time range, distinct time groups and overlap of each split; ``split_groups`` lists the groups."""
    cells = df.filter(F.col(time).isNotNull()).groupBy(F.col(time).alias("g"), split).agg(F.count(F.lit(1)).alias("n"))
    shared = cells.groupBy("g").agg(F.collect_set(split).alias("in_splits"))
    cells = cells.join(shared, "g").withColumn("__shared", F.size("in_splits") > 1)
    return cells.groupBy(split).agg(
        F.sum("n").alias("rows"),
        F.min("g").alias("time_min"),
        F.max("g").alias("time_max"),
        F.count(F.lit(1)).alias("time_group_count"),
        (F.count_if("__shared") == 0).alias("group_disjoint"),
    )


def partition_table(
    df: DataFrame, requested: Mapping[str, float], *, role: str, target: str, time: str = "event_time"
) -> DataFrame:
    """Observed against requested share, positives and the both-classes flag of each part."""
    share = F.create_map(*[x for k, v in requested.items() for x in (F.lit(k), F.lit(float(v)))])
    per_role = df.groupBy(role).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(target).cast("bigint").alias("positives"),
        F.avg(F.col(target).cast("double")).alias("positive_rate"),
        F.min(time).alias("time_min"),
        F.max(time).alias("time_max"),
        (F.min(target) != F.max(target)).alias("both_classes"),
    )
    # One row per role reaches the sum below.
    total = df.agg(F.count(F.lit(1))).first()[0]
    return per_role.withColumn("requested_share", share[F.col(role)]).withColumn(
        "observed_share", F.col("rows") / F.lit(float(total))
    )


def require_both_classes(df: DataFrame, *, role: str, target: str) -> None:
    bad = df.groupBy(role).agg(F.min(target).alias("lo"), F.max(target).alias("hi")).filter("lo = hi").collect()
    if bad:
        raise ValueError(f"partitions with one class only: {sorted(r[role] for r in bad)}")
