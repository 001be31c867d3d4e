"""Strictly-past history of an entity at the time of each transaction.

A row sees the rows of its key with an earlier timestamp; rows that share a
timestamp see the same state.

Two plans give the same result.  The *plain* plan is one window per key set; it
puts a key's whole history into one task, so it is used only after counting that
no key has more than ``plain_limit`` rows.  The *two-level* plan takes totals per
(key, time bucket) for the state at the start of a bucket, and a window inside
(key, time bucket) for the rest.  A bucket holds a bounded share of all rows,
hence so does every window group.  A timestamp shared by very many rows is a
bucket of its own where the state is the same for every row, so its rows may be
spread over salts freely.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.ranks import Cuts, fit_cuts, with_buckets
from riskloom.session import dealt

SALTS = 64
PLAIN_LIMIT = 2_000_000


@dataclass(frozen=True)
class Trail:
    """What to derive for one key set; leave a name out to skip that feature."""

    keys: tuple[str, ...]
    count: str | None = None
    total: str | None = None
    amount: str | None = None
    seconds: str | None = None


def time_cuts(df: DataFrame, time: str = "event_time", buckets: int | None = None) -> Cuts:
    """Equal-depth time buckets of a table."""
    micros = df.select(F.unix_micros(F.col(time)).alias("t"))
    return fit_cuts(micros, ["t"], buckets)["t"]


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    return int(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0)


def _cents(column: str) -> Column:
    """Money as whole cents: the sum does not depend on row order."""
    return F.coalesce(F.round(F.col(column).cast("double") * 100).cast("bigint"), F.lit(0).cast("bigint"))


def _features(trail: Trail, count: Column, cents: Column, last: Column) -> dict[str, Column]:
    out: dict[str, Column] = {}
    if trail.count:
        out[trail.count] = count
    if trail.total:
        out[trail.total] = F.coalesce(cents, F.lit(0)) / F.lit(100.0)
    if trail.seconds:
        out[trail.seconds] = (F.col("__t") - last) / F.lit(1_000_000.0)
    return out


def _plain(df: DataFrame, trail: Trail) -> DataFrame:
    past = Window.partitionBy(*trail.keys).orderBy("__t").rangeBetween(Window.unboundedPreceding, -1)
    cents = F.sum(_cents(trail.amount)).over(past) if trail.total else F.lit(0)
    return df.withColumns(_features(trail, F.count(F.lit(1)).over(past), cents, F.max("__t").over(past)))


def _two_level(df: DataFrame, base: DataFrame, trail: Trail, cuts: Cuts, size: int, gaps: set[str]) -> DataFrame:
    # Null keys form one group: where there are any, give them a value so that the join below keeps them.
    keys = [f"__key{i}" if c in gaps else c for i, c in enumerate(trail.keys)]
    named = {k: F.coalesce(F.col(c).cast("string"), F.lit("\0")) for k, c in zip(keys, trail.keys) if c in gaps}
    # Without a heavy timestamp there is no salt: a constant key would keep the join from taking the window's partitions.
    group = [*keys, "__t_b", *(["__salt"] if cuts.points else [])]
    money = [F.sum(_cents(trail.amount)).alias("__paid")] if trail.total else []
    point = cuts.is_point(F.col("__t_b"))

    totals = base.withColumns(named).groupBy(*keys, "__t_b").agg(
        F.count(F.lit(1)).alias("__n"), F.max("__t").alias("__last"), *money
    )
    # At most one row per time bucket of a key.
    totals = dealt(totals, size, *keys)
    earlier = Window.partitionBy(*keys).orderBy("__t_b").rowsBetween(Window.unboundedPreceding, -1)
    salts = F.when(point, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    start = totals.select(
        *keys,
        "__t_b",
        F.sum("__n").over(earlier).alias("__n0"),
        F.max("__last").over(earlier).alias("__last0"),
        *([F.sum("__paid").over(earlier).alias("__paid0")] if trail.total else []),
    )
    start = start.withColumn("__salt", F.explode(salts)) if cuts.points else start
    inside = Window.partitionBy(*group).orderBy("__t").rangeBetween(Window.unboundedPreceding, -1)
    salt = F.when(point, F.pmod(F.col("__row"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    local = {"__n1": F.count(F.lit(1)).over(inside), "__last1": F.max("__t").over(inside)}
    if trail.total:
        local["__paid1"] = F.sum(_cents(trail.amount)).over(inside)
    rows = dealt(df.withColumns(named).withColumn("__salt", salt), size, *group).withColumns(local).join(start, group, "left")
    zero = F.lit(0)
    cents = (
        F.coalesce(F.col("__paid0"), zero) + F.coalesce(F.col("__paid1"), zero) if trail.total else zero
    )
    features = _features(
        trail,
        F.coalesce(F.col("__n0"), zero) + F.col("__n1"),
        cents,
        F.coalesce(F.col("__last1"), F.col("__last0")),
    )
    return rows.withColumns(features).drop(
        *named, "__salt", *local, "__n0", "__last0", *(["__paid0"] if trail.total else [])
    )


def with_history(
    df: DataFrame,
    trails: Sequence[Trail],
    *,
    time: str = "event_time",
    row_id: str = "txn_id",
    cuts: Cuts | None = None,
    plain_limit: int = PLAIN_LIMIT,
) -> DataFrame:
    """Add the history columns of every trail.

    ``df`` is read once per key set for the size check and, in the two-level plan, for the
    bucket totals, so pass a stored table rather than an expensive join.
    """
    bounded: list[frozenset[str]] = []
    plain: list[Trail] = []
    large: list[Trail] = []
    for trail in sorted(trails, key=lambda t: len(t.keys)):
        keys = frozenset(trail.keys)
        # A finer key set cannot have larger groups than a coarser one already checked.
        if any(b <= keys for b in bounded) or largest_group(df, trail.keys) <= plain_limit:
            bounded.append(keys)
            plain.append(trail)
        else:
            large.append(trail)
    checked = sorted({k for trail in large for k in trail.keys})
    facts = df.agg(F.count(F.lit(1)), *[F.count_if(F.col(k).isNull()) for k in checked]).first()
    size, gaps = facts[0], {k for k, n in zip(checked, facts[1:]) if n}
    out, micros = df, F.unix_micros(F.col(time))
    if large:
        out = out.withColumns({"__t": micros, "__row": F.xxhash64(F.col(row_id))})
        cuts = cuts or time_cuts(df, time)
        base = out = with_buckets(out, {"__t": cuts}, "_b")
        for trail in large:
            out = _two_level(out, base, trail, cuts, size, gaps)
        out = out.drop("__t_b", "__t", "__row")
    # ``plain`` runs from coarse to fine keys: a key set that extends the one before it
    # needs no further shuffle.
    dealt_by: frozenset[str] | None = None
    for trail in plain:
        if dealt_by is None or not dealt_by <= set(trail.keys):
            out, dealt_by = dealt(out, size, *trail.keys), frozenset(trail.keys)
        # The time in microseconds is derived behind the shuffle.
        out = _plain(out.withColumn("__t", micros), trail).drop("__t")
    return out


def payment_trails() -> list[Trail]:
    sender = ("sender_bank_id", "sender_account_id")
    receiver = ("receiver_bank_id", "receiver_account_id")
    return [
        Trail(receiver, "receiver_prior_transaction_count", "receiver_prior_total_amount_received",
              "amount_received", "receiver_seconds_since_previous"),
        Trail(sender, "sender_prior_transaction_count", "sender_prior_total_amount_paid", "amount_paid",
              "sender_seconds_since_previous"),
        Trail(sender + receiver, "pair_prior_transaction_count"),
    ]


def ledger_trails(amount: str = "amount") -> list[Trail]:
    sender, receiver = ("sender_account_id",), ("receiver_account_id",)
    return [
        Trail(receiver, "receiver_prior_transaction_count", "receiver_prior_total_amount", amount,
              "receiver_seconds_since_previous"),
        Trail(sender, "sender_prior_transaction_count", "sender_prior_total_amount", amount,
              "sender_seconds_since_previous"),
        Trail(sender + receiver, "pair_prior_transaction_count"),
    ]
