"""Checks that must hold before a metric is computed; each is one aggregate."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns that encode an outcome or a post-transaction state, per dataset.
PAYMENT_DENYLIST = ("label", "Is Laundering")
LEDGER_DENYLIST = (
    "label",
    "auxiliary_fraud_label",
    "auxiliary_money_laundering_label",
    "money_laundering_typology",
    "fraud_probability",
    "metadata",
    "sender_balance_after",
    "balance_depletion_fraction",
    "reported_hour",
    "reported_day_of_week",
    "reported_day_of_month",
    "reported_month",
    "risk_score",
    "customer_risk_score",
    "isFraud",
    "isMoneyLaundering",
)


def _binary(c: str) -> Column:
    x = F.col(c).try_cast("double")
    return F.coalesce(x.isin(0.0, 1.0), F.lit(False))


def _unit(c: str) -> Column:
    x = F.col(c).try_cast("double")
    return F.coalesce(~F.isnan(x) & (x >= 0) & (x <= 1), F.lit(False))


def contract_violations(
    df: DataFrame,
    *,
    binary: Sequence[str] = (),
    unit_interval: Sequence[str] = (),
    not_null: Sequence[str] = (),
    subset: Mapping[str, str] | None = None,
) -> DataFrame:
    """Violations per contract: binary columns, values in [0, 1], no nulls, ``key`` only where ``value``."""
    checks: dict[str, Column] = {f"binary:{c}": ~_binary(c) for c in binary}
    checks |= {f"unit_interval:{c}": ~_unit(c) for c in unit_interval}
    checks |= {f"not_null:{c}": F.col(c).isNull() for c in not_null}
    checks |= {
        f"subset:{a}<={b}": F.col(a).cast("boolean") & ~F.col(b).cast("boolean") for a, b in (subset or {}).items()
    }
    wide = df.agg(*[F.count_if(bad).alias(f"c{i}") for i, bad in enumerate(checks.values())])
    pairs = F.array(
        *[F.struct(F.lit(n).alias("contract"), F.col(f"c{i}").alias("violations")) for i, n in enumerate(checks)]
    )
    return wide.select(F.explode(pairs).alias("e")).select("e.*")


def require_contracts(df: DataFrame, **contracts) -> None:
    broken = contract_violations(df, **contracts).filter("violations > 0").collect()
    if broken:
        raise ValueError("; ".join(f"{r['contract']}: {r['violations']} rows" for r in broken))


def strict_binary_target(df: DataFrame, target: str) -> DataFrame:
    """Cast a 0/1 label; missing or other values are an error."""
    require_contracts(df, binary=[target])
    return df.withColumn(target, F.col(target).cast("double").cast("int"))


def require_time(df: DataFrame, time: str) -> None:
    require_contracts(df, not_null=[time])


def feature_columns(columns: Iterable[str], denylist: Iterable[str], *, internal: Iterable[str] = ("event_time", "txn_id")) -> list[str]:
    """Columns a model may see: not denied, not internal, not starting with two underscores."""
    denied = {*denylist, *internal}
    return [c for c in columns if c not in denied and not c.startswith("__")]


def require_no_leakage(features: Iterable[str], denylist: Iterable[str]) -> None:
    denied = {d.casefold() for d in denylist}
    leaked = sorted(f for f in features if f.casefold() in denied)
    if leaked:
        raise ValueError(f"denied columns among the features: {leaked}")


def require_unique_names(columns: Sequence[str]) -> None:
    twice = sorted({c for c in columns if list(columns).count(c) > 1})
    if twice:
        raise ValueError(f"repeated columns: {twice}")
