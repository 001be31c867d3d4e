"""SQL of the shared steps, for checking results in another engine."""

from __future__ import annotations

from riskloom.plans.binding import ACTIVATION, ALERT_THRESHOLD, RULES, SCORE_BASE, SCORECARD

TXN = """
txn as materialized (
  select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, epoch_us(l_shipdate)) as txn_id,
    l_shipdate as event_time,
    c_nationkey::varchar as sender_bank_id, o_custkey::varchar as sender_account_id,
    s_nationkey::varchar as receiver_bank_id, l_suppkey::varchar as receiver_account_id,
    l_extendedprice as amount_paid, floor(l_extendedprice * (1 - l_discount) * 100 + 0.5) / 100 as amount_received,
    rc.r_name as payment_currency, rs.r_name as receiving_currency, o_orderpriority as payment_format,
    c_acctbal as sender_balance_before,
    case when l_returnflag = 'R' and (l_extendedprice >= 60000 or (c_nationkey <> s_nationkey and l_discount >= 0.08))
      then 1 else 0 end as label
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
    join supplier on l_suppkey = s_suppkey
    join nation nc on c_nationkey = nc.n_nationkey join region rc on nc.n_regionkey = rc.r_regionkey
    join nation ns on s_nationkey = ns.n_nationkey join region rs on ns.n_regionkey = rs.r_regionkey
)"""

PAST = "range between unbounded preceding and interval 1 microsecond preceding"


def cents(column: str) -> str:
    return f"round({column} * 100)::bigint"


HIST = f"""
hist as materialized (
  select *,
    (count(*) over s)::bigint as sender_prior_transaction_count,
    (coalesce(sum({cents('amount_paid')}) over s, 0) / 100.0)::double as sender_prior_total_amount_paid,
    ((epoch_us(event_time) - epoch_us(max(event_time) over s)) / 1000000.0)::double as sender_seconds_since_previous,
    (count(*) over r)::bigint as receiver_prior_transaction_count,
    (coalesce(sum({cents('amount_received')}) over r, 0) / 100.0)::double as receiver_prior_total_amount_received,
    ((epoch_us(event_time) - epoch_us(max(event_time) over r)) / 1000000.0)::double as receiver_seconds_since_previous,
    (count(*) over p)::bigint as pair_prior_transaction_count
  from txn
  window s as (partition by sender_bank_id, sender_account_id order by event_time {PAST}),
    r as (partition by receiver_bank_id, receiver_account_id order by event_time {PAST}),
    p as (partition by sender_bank_id, sender_account_id, receiver_bank_id, receiver_account_id
          order by event_time {PAST})
)"""

FEATURES = """
feat as materialized (
  select *, hour(event_time)::int as event_hour, (isodow(event_time) - 1)::int as event_day_of_week,
    (case when isodow(event_time) >= 6 then 1 else 0 end)::int as is_weekend,
    ln(1 + greatest(amount_paid, 0)) as amount_paid_log, ln(1 + greatest(amount_received, 0)) as amount_received_log,
    abs(amount_paid - amount_received)
      / (abs(amount_paid) + abs(amount_received) + 2.220446049250313e-16::double) as amount_relative_difference,
    (payment_currency = receiving_currency)::int as same_currency,
    (sender_bank_id <> receiver_bank_id)::int as cross_bank
  from hist
)"""


def sigmoid(x: str) -> str:
    return f"(1 / (1 + exp(-greatest(-50::double, least(50::double, {x})))))"


def settled_sql(x: str) -> str:
    return f"(floor({x} * 1e10::double + 0.5::double) / 1e10::double)"


MARGIN = f"{SCORE_BASE}::double" + "".join(f" + {c!r}::double * {f}" for f, c in SCORECARD.items())

SCORED = f"""
scored as materialized (
  select *, {sigmoid(MARGIN)} as risk, {sigmoid(MARGIN)} >= {ALERT_THRESHOLD}::double as alert from feat
)"""


def _nearest(name: str, desired: str, lower: str, upper: str, source: str) -> str:
    return f"""
{name} as materialized (
  select before, t from prefix, {source}
  where before between {lower} and {upper}
  order by abs(before - ({desired})), before limit 1
)"""


CUTS = (
    """
prefix as materialized (
  select t, (sum(n) over (order by t) - n)::bigint as before
  from (select event_time as t, count(*) as n from scored group by 1)
),
total as materialized (select count(*)::bigint as n from scored),"""
    + _nearest("cut1", "round_even(n * 0.6::double, 0)", "1", "n - 2", "total")
    + ","
    + _nearest("cut5", "round_even(n * 0.8::double, 0)", "(select before from cut1) + 1", "n - 1", "total")
    + ", sizes as materialized (select cut1.before as a, cut5.before - cut1.before as m from cut1, cut5),"
    + _nearest("cut2", "a + round_even(m * 0.25::double, 0)", "a + 1", "a + m - 3", "sizes")
    + ","
    + _nearest("cut3", "a + round_even(m * 0.5::double, 0)", "(select before from cut2) + 1", "a + m - 2", "sizes")
    + ","
    + _nearest("cut4", "a + round_even(m * 0.75::double, 0)", "(select before from cut3) + 1", "a + m - 1", "sizes")
    + """,
roled as materialized (
  select s.*, case when event_time < cut1.t then 'train' when event_time < cut2.t then 'calibration_fit'
      when event_time < cut3.t then 'calibration_select' when event_time < cut4.t then 'rule_audit'
      when event_time < cut5.t then 'policy_select' else 'test' end as role,
    case when event_time < cut1.t then 'train' when event_time < cut5.t then 'validation' else 'test' end as split
  from scored s, cut1, cut2, cut3, cut4, cut5
)"""
)

CATEGORY = """
catraw as (
  select coalesce(payment_format, '<MISSING>') as category, count(*) as n,
    (sum(label) + 20 * (select avg(label) from roled where role = 'train')) / (count(*) + 20) as raw
  from roled where role = 'train' group by 1
),
catrisk as materialized (
  select category, n, case when (select max(raw) > min(raw) from catraw)
    then (raw - (select min(raw) from catraw)) / (select max(raw) - min(raw) from catraw) else 0 end as risk_value
  from catraw
)"""


def _fit_columns() -> list[str]:
    out: dict[str, str] = {}
    for rule in RULES:
        for c in rule["conditions"]:
            f, op = c["feature"], c["operator"]
            if op in ("category_risk", "equals"):
                continue
            out[f"m_{f}"] = f"quantile_cont({f}, 0.5)"
            if op.endswith("quantile"):
                out[threshold_name(f, c["value"])] = f"quantile_cont({f}, {c['value']})"
    return [f"{e}::double as {n}" for n, e in out.items()]


def threshold_name(feature: str, q: float) -> str:
    return f"q_{feature}_{str(q).replace('.', '_')}"


FIT = f"fit as materialized (select {', '.join(_fit_columns())} from roled where role = 'train')"


def _condition(c: dict) -> str:
    f, op, value = c["feature"], c["operator"], c["value"]
    soft = c.get("softness", 0.1)
    default = "absolute" if op in ("greater", "less", "outside_range", "equals") else "relative"
    mode = c.get("softness_mode", default)

    def scale(threshold: str) -> str:
        if mode == "absolute":
            return f"greatest({soft}::double, 1e-6)"
        return f"greatest(abs({threshold}) * {soft}::double, {soft}::double, 1e-6)"

    if op == "equals":
        return f"coalesce(({f} = {value})::int, 0)::double"
    if op == "category_risk":
        return sigmoid(f"(coalesce(risk_value, 0) - {value}::double) / {scale(str(value))}")
    x = f"coalesce({f}::double, m_{f})"
    if op == "outside_range":
        low, high = value
        return (
            f"greatest({sigmoid(f'({low}::double - {x}) / {scale(str(low))}')}, "
            f"{sigmoid(f'({x} - {high}::double) / {scale(str(high))}')})"
        )
    t = threshold_name(f, value) if op.endswith("quantile") else f"{value}::double"
    sign = f"{x} - {t}" if op.startswith("greater") else f"{t} - {x}"
    return sigmoid(f"({sign}) / {scale(t)}")


def _rule(rule: dict) -> str:
    parts = [_condition(c) for c in rule["conditions"]]
    if len(parts) == 1:
        return parts[0]
    return " * ".join(parts) if rule.get("conjunction") == "product" else f"least({', '.join(parts)})"


TRUTH = f"""
truth as materialized (
  select roled.*, {', '.join(f"{_rule(r)} as rule__{r['name']}" for r in RULES)}
  from roled cross join fit left join catrisk on coalesce(payment_format, '<MISSING>') = category
)"""

NAMES = [r["name"] for r in RULES]
STEPS = {
    "txn": TXN, "hist": HIST, "feat": FEATURES, "scored": SCORED, "roled": CUTS,
    "catrisk": CATEGORY, "fit": FIT, "truth": TRUTH,
}


def sql(upto: str, query: str, *more: str) -> str:
    """``query`` after the shared steps up to ``upto`` and further CTEs."""
    names = list(STEPS)
    parts = [STEPS[n] for n in names[: names.index(upto) + 1]]
    return "with " + ",\n".join([*parts, *more]) + "\n" + query


def unpivot_rules(columns: str, where: str = "true", source: str = "truth") -> str:
    """Long form (columns, rule, v) of the truth columns."""
    return " union all ".join(
        f"select {columns}, '{n}' as rule, rule__{n} as v from {source} where {where}" for n in NAMES
    )


def any_active(names=NAMES, level: float = ACTIVATION) -> str:
    return "(" + " or ".join(f"rule__{n} >= {level}" for n in names) + ")" if names else "false"


def count_active(names=NAMES, level: float = ACTIVATION) -> str:
    return "(" + " + ".join(f"(rule__{n} >= {level})::int" for n in names) + ")"
