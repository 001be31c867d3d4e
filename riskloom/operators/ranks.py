"""Global ranks, prefix sums and exact quantiles without a one-task sort.

A window without partition keys would send every row to one task.  Here the
order key is first cut into value buckets of about equal depth.  The cuts are
fitted once and then used as constants, so a row's bucket depends on its value
alone and a recomputed task puts it in the same place.

A value so frequent that it fills a bucket on its own becomes a *point* bucket:
it holds that single value, so its rows can be subdivided by the next order key
and finally by the row-id digest.  No bucket holds more than a few times
``rows / buckets`` rows however the keys are skewed.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from riskloom.session import BROADCAST_ROWS, gathered, stage, wide_buckets


@dataclass(frozen=True)
class Cuts:
    """Fitted bucket limits of one order key."""

    splits: tuple[float, ...]
    points: tuple[int, ...]

    @property
    def single(self) -> bool:
        return len(self.splits) < 3

    def is_point(self, bucket: Column) -> Column:
        return bucket.isin(list(self.points)) if self.points else F.lit(False)


def _cuts_from_quantiles(quantiles: Sequence[float]) -> Cuts:
    seen: dict[float, int] = {}
    for value in quantiles:
        seen[float(value)] = seen.get(float(value), 0) + 1
    splits = [-math.inf]
    heavy = []
    for value in sorted(seen):
        if value == splits[-1] or not math.isfinite(value):
            continue
        splits.append(value)
        if seen[value] > 1:
            heavy.append(value)
            splits.append(math.nextafter(value, math.inf))
    splits = sorted(set(splits)) + [math.inf]
    points = tuple(splits.index(value) for value in heavy)
    return Cuts(tuple(splits), points)


def fit_cuts(df: DataFrame, columns: Sequence[str], buckets: int | None = None) -> dict[str, Cuts]:
    """Equal-depth cuts for several numeric columns in one pass."""
    n = buckets or wide_buckets(df.sparkSession)
    levels = F.array(*[F.lit(i / n) for i in range(1, n)])
    fitted = df.agg(
        *[F.percentile_approx(F.col(c).cast("double"), levels, F.lit(8 * n)).alias(c) for c in columns]
    ).first()
    return {c: _cuts_from_quantiles(fitted[c] or ()) for c in columns}


def with_buckets(df: DataFrame, cuts: Mapping[str, Cuts], suffix: str = "__b") -> DataFrame:
    """Add ``<column><suffix>``, the bucket number of each column in ``cuts``."""
    wide = [c for c, k in cuts.items() if not k.single]
    out = df
    if wide:
        casts = {f"{c}{suffix}_in": F.col(c).cast("double") for c in wide}
        out = Bucketizer(
            inputCols=list(casts),
            outputCols=[f"{c}{suffix}_out" for c in wide],
            splitsArray=[list(cuts[c].splits) for c in wide],
            handleInvalid="keep",
        ).transform(out.withColumns(casts))
        out = out.withColumns({f"{c}{suffix}": F.col(f"{c}{suffix}_out").cast("int") for c in wide})
        out = out.drop(*casts, *[f"{c}{suffix}_out" for c in wide])
    flat = {f"{c}{suffix}": F.lit(0) for c, k in cuts.items() if k.single}
    return out.withColumns(flat) if flat else out


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null; the keys of ``left`` stay."""
    names = {k: f"__right_{i}" for i, k in enumerate(keys)}
    right = right.withColumnsRenamed(names)
    condition = F.lit(True)
    for k, other in names.items():
        condition = condition & left[k].eqNullSafe(right[other])
    return left.join(right, condition, how).drop(*names.values())


def prefix_sums(
    cells: DataFrame,
    key: str,
    sums: Mapping[str, str],
    *,
    partition: Sequence[str] = (),
    descending: bool = False,
    bucket: str | None = None,
) -> DataFrame:
    """Exclusive running sums over distinct keys, and the partition totals; a null partition is one of its own.

    ``cells`` has one row per (partition, key).  For each ``out -> column`` in
    ``sums`` the result adds ``<out>_before`` (sum over smaller keys, or larger
    ones when ``descending``) and ``<out>_total``.  Pass a staged table: it is
    read once for the bucket totals and once for the running sums.
    """
    if bucket is None:
        cuts = fit_cuts(cells, [key])
        cells = with_buckets(cells, cuts, "__bucket")
        bucket = f"{key}__bucket"
        drop = [bucket]
    else:
        drop = []
    parts = list(partition)
    direction = F.col(key).desc() if descending else F.col(key).asc()
    step = F.col(bucket).desc() if descending else F.col(bucket).asc()
    totals = cells.groupBy(*parts, bucket).agg(
        *[F.sum(column).alias(f"{out}__sum") for out, column in sums.items()]
    )
    # At most two rows per bucket and partition reach these windows.
    over_buckets = Window.partitionBy(*parts, F.lit(0)).orderBy(step)
    earlier = over_buckets.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parts, F.lit(0))
    offsets = totals.select(
        *parts,
        bucket,
        *[F.sum(f"{o}__sum").over(earlier).alias(f"{o}__offset") for o in sums],
        *[F.sum(f"{o}__sum").over(whole).alias(f"{o}_total") for o in sums],
    )
    inside = Window.partitionBy(*parts, bucket).orderBy(direction).rowsBetween(Window.unboundedPreceding, -1)
    joined = null_safe_join(cells, offsets, [*parts, bucket])
    zero = F.lit(0)
    return joined.withColumns(
        {
            f"{o}_before": F.coalesce(F.col(f"{o}__offset"), zero) + F.coalesce(F.sum(c).over(inside), zero)
            for o, c in sums.items()
        }
    ).drop(*[f"{o}__offset" for o in sums], *drop)


def _levels(df: DataFrame, order: Sequence[tuple[str, str]], row_id: str) -> tuple[DataFrame, list[str], list[Column], Column]:
    """``df`` with the level columns of a global order, the sort keys and the tie digest.

    Rows are ordered by their levels first; a level holds a bounded share of the rows.
    """
    keys = [F.col(c).cast("double") * (-1.0 if d == "desc" else 1.0) for c, d in order]
    tie = F.md5(F.col(row_id).cast("string"))
    names = [f"__k{i}" for i in range(len(order))]
    cuts = fit_cuts(df.select(*[k.alias(n) for k, n in zip(keys, names)]), names) if names else {}
    base = with_buckets(df.withColumns(dict(zip(names, keys))), cuts, "_b") if names else df
    levels: list[str] = []
    at_point: Column = F.lit(True)
    for k in names:
        raw = F.col(f"{k}_b")
        base = base.withColumn(f"{k}_l", F.when(at_point, raw).otherwise(F.lit(-1)))
        levels.append(f"{k}_l")
        at_point = at_point & cuts[k].is_point(raw)
        if not cuts[k].points:
            # Further levels would be constants, which keep a window from taking the shuffle before it.
            break
    else:
        base = base.withColumn(
            "__tie_l", F.when(at_point, F.conv(F.substring(tie, 1, 3), 16, 10).cast("int")).otherwise(F.lit(-1))
        )
        levels.append("__tie_l")
    return base.drop(*names, *[f"{k}_b" for k in names]), levels, keys, tie


def nth_row(df: DataFrame, order: Sequence[tuple[str, str]], row_id: str, place: int) -> Row | None:
    """Order keys ``k0``, ``k1`` .. and digest ``tie`` of the row that ``with_global_rank`` numbers ``place``, if there is one.

    Rows are counted per level; only those of the one that holds the place are sorted.
    """
    base, levels, keys, tie = _levels(df, order, row_id)
    earlier = Window.partitionBy(F.lit(0)).orderBy(*levels).rowsBetween(Window.unboundedPreceding, -1)
    counts = base.groupBy(*levels).agg(F.count(F.lit(1)).alias("n"))
    placed = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    spot = placed.filter((F.col("before") < place) & (F.col("before") + F.col("n") >= place)).first()
    if spot is None:
        return None
    for level in levels:
        base = base.filter(F.col(level) == spot[level])
    found = base.select(*[k.alias(f"k{i}") for i, k in enumerate(keys)], tie.alias("tie"))
    names = found.columns
    inside = Window.partitionBy(F.lit(0)).orderBy(*names)
    return found.withColumn("n", F.row_number().over(inside)).filter(F.col("n") == place - spot["before"]).first()


def up_to(cutoff: Row | None, order: Sequence[tuple[str, str]], row_id: str) -> Column:
    """Whether a row stands at or before the row ``nth_row`` found; false without one.  The order's columns hold no nulls."""
    if cutoff is None:
        return F.lit(False)
    out = F.md5(F.col(row_id).cast("string")) <= F.lit(cutoff["tie"])
    for i, (c, d) in reversed(list(enumerate(order))):
        key, limit = F.col(c).cast("double") * (-1.0 if d == "desc" else 1.0), F.lit(cutoff[f"k{i}"])
        out = (key < limit) | ((key == limit) & out)
    return out


def with_global_rank(
    df: DataFrame,
    order: Sequence[tuple[str, str]],
    row_id: str,
    *,
    partition: Sequence[str] = (),
    out: str = "rank",
    weight: str | Sequence[str] | None = None,
) -> DataFrame:
    """Number the rows 1..n (per partition) by ``order`` with ties broken by md5 of the row id.

    Rows with a null partition key are a partition of their own.

    ``order`` lists (numeric column, "asc" | "desc").  With ``weight`` the result is
    the exclusive running weight ``<out>_before`` instead of a rank; with several weights
    (replicates of one order) one column ``<out>_before_<i>`` each.  ``df`` should be
    a staged, narrow table because it is read three times.  Rows are shuffled once, by level;
    sort keys and digests are derived behind the shuffle.
    """
    parts = list(partition)
    base, levels, keys, tie = _levels(df, order, row_id)
    weights = [] if weight is None else [weight] if isinstance(weight, str) else list(weight)
    amounts = [F.col(w) for w in weights] or [F.lit(1).cast("bigint")]
    counts = base.groupBy(*parts, *levels).agg(
        F.count(F.lit(1)).alias("__rows"), *[F.sum(a).alias(f"__n{i}") for i, a in enumerate(amounts)]
    )
    earlier = (
        Window.partitionBy(*parts, F.lit(0)).orderBy(*levels).rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = counts.select(
        *parts, *levels, "__rows",
        *[F.coalesce(F.sum(f"__n{i}").over(earlier), F.lit(0)).alias(f"__offset{i}") for i in range(len(amounts))],
    )
    offsets = stage(offsets, "rank-offsets")
    many, size = offsets.agg(F.count(F.lit(1)), F.sum("__rows")).first()
    offsets = offsets.drop("__rows")
    names = [f"__k{i}" for i in range(len(keys))]
    base = gathered(base, size or 0, *parts, *levels).withColumns({**dict(zip(names, keys)), "__tie": tie})
    inside = Window.partitionBy(*parts, *levels).orderBy(*names, "__tie")
    if weights:
        running = inside.rowsBetween(Window.unboundedPreceding, -1)
        outs = [f"{out}_before"] if isinstance(weight, str) else [f"{out}_before_{i}" for i in range(len(weights))]
        local = {n: F.coalesce(F.sum(a).over(running), F.lit(0)) for n, a in zip(outs, amounts)}
    else:
        outs, local = [out], {out: F.row_number().over(inside)}
    ranked = base.withColumns(local).drop(*names, "__tie")
    # One row per level; broadcast if they are few, so that the rows stay where they are.
    joined = null_safe_join(ranked, F.broadcast(offsets) if many <= BROADCAST_ROWS else offsets, [*parts, *levels])
    numbered = joined.withColumns({n: F.col(f"__offset{i}") + F.col(n) for i, n in enumerate(outs)})
    return numbered.drop(*levels, *[f"__offset{i}" for i in range(len(amounts))])


def quantile_positions(n: int, q: float) -> tuple[int, int, float]:
    """Lower row, upper row and fraction of the linearly interpolated quantile."""
    place = (n - 1) * float(q)
    low = int(math.floor(place))
    return low, min(low + 1, n - 1), place - low


def exact_quantiles(
    df: DataFrame, wanted: Mapping[str, Sequence[float]], *, weight: str | None = None
) -> dict[str, dict[float, float | None]]:
    """Exact linearly interpolated quantiles of several columns.

    Rows are counted per value bucket.  The bucket totals (a few thousand numbers at most)
    tell which buckets hold the requested positions; only those rows are shuffled and sorted,
    and only the neighbours of each position come back to the driver.  ``df`` should be a
    staged table because it is read three times.
    """
    columns = list(wanted)
    null = F.lit(None).cast("double")
    slim = df.select(
        *[F.nanvl(F.col(c).cast("double"), null).alias(c) for c in columns],
        (F.col(weight) if weight else F.lit(1)).cast("bigint").alias("__w"),
    )
    bucketed = with_buckets(slim, fit_cuts(slim, columns))
    pairs = F.array(
        *[F.struct(F.lit(c).alias("name"), F.col(c).alias("value"), F.col(f"{c}__b").alias("b")) for c in columns]
    )
    long = bucketed.select("__w", F.explode(pairs).alias("p")).select("__w", "p.*").filter(F.col("value").isNotNull())
    buckets = long.groupBy("name", "b").agg(F.sum("__w").alias("n")).collect()
    result: dict[str, dict[float, float | None]] = {c: {q: None for q in qs} for c, qs in wanted.items()}
    # (name, bucket, first row of the bucket, requested rows that fall into it)
    spots: list[tuple[str, int, int, list[int]]] = []
    sizes: dict[str, int] = {}
    for c, qs in wanted.items():
        mine = sorted((r["b"], int(r["n"])) for r in buckets if r["name"] == c)
        n = sizes[c] = sum(k for _, k in mine)
        if not n:
            continue
        rows = sorted({p for q in qs for p in quantile_positions(n, q)[:2]})
        start = 0
        for b, k in mine:
            inside = [p for p in rows if start <= p < start + k]
            if inside:
                spots.append((c, b, start, inside))
            start += k
    if not spots:
        return result
    places = df.sparkSession.createDataFrame(spots, "name string, b int, start bigint, places array<bigint>")
    within = Window.partitionBy("name", "b").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    # ``places`` has one row per wanted bucket.
    wanted_rows = long.join(F.broadcast(places.select("name", "b")), ["name", "b"], "left_semi")
    cells = wanted_rows.groupBy("name", "b", "value").agg(F.sum("__w").alias("n"))
    ranked = cells.join(F.broadcast(places), ["name", "b"]).withColumn(
        "first", F.col("start") + F.coalesce(F.sum("n").over(within), F.lit(0))
    )
    first, last = F.col("first"), F.col("first") + F.col("n")
    hits = F.filter("places", lambda p: (p >= first) & (p < last))
    found = ranked.select("name", "value", hits.alias("hits")).filter(F.size("hits") > 0).collect()
    value_at = {(r["name"], p): float(r["value"]) for r in found for p in r["hits"]}
    for c, qs in wanted.items():
        for q in qs:
            if sizes[c]:
                low, high, part = quantile_positions(sizes[c], q)
                a, b = value_at[c, low], value_at[c, high]
                result[c][q] = a + (b - a) * part
    return result
