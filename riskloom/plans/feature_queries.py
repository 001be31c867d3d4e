"""Causal history, semantic features, keys, joins and splits."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.keys import normalize_key
from riskloom.functions.semantics import balance_features, calendar_features, elapsed_features, metadata_time, payment_features
from riskloom.operators import contracts, counterfactual, joins, preprocess, profile, sampling, splits
from riskloom.operators.history import Trail, ledger_trails, payment_trails, with_history
from riskloom.plans import binding
from riskloom.plans.oracle import PAST, sql
from riskloom.plans.registry import query
from riskloom.session import stage


def _payments(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return stage(binding.transactions(spark, sf_dir).select("txn_id", "event_time", *columns), "payments")


KEYS = ("sender_bank_id", "sender_account_id", "receiver_bank_id", "receiver_account_id")


@query(
    "causal_prior_count",
    sql("hist", """select txn_id, sender_prior_transaction_count, receiver_prior_transaction_count,
      pair_prior_transaction_count from hist"""),
)
def causal_prior_count(spark, sf_dir):
    trails = [Trail(t.keys, count=t.count) for t in payment_trails()]
    return with_history(_payments(spark, sf_dir, *KEYS), trails).select("txn_id", *[t.count for t in trails])


@query(
    "causal_prior_sum",
    sql("hist", """select txn_id, round(sender_prior_total_amount_paid, 6) as sender_prior_total_amount_paid,
      round(receiver_prior_total_amount_received, 6) as receiver_prior_total_amount_received from hist"""),
)
def causal_prior_sum(spark, sf_dir):
    trails = [Trail(t.keys, total=t.total, amount=t.amount) for t in payment_trails() if t.total]
    rows = _payments(spark, sf_dir, *KEYS, "amount_paid", "amount_received")
    return with_history(rows, trails).select("txn_id", *[t.total for t in trails])


@query(
    "seconds_since_previous",
    sql("hist", """select txn_id, round(sender_seconds_since_previous, 6) as sender_seconds_since_previous,
      round(receiver_seconds_since_previous, 6) as receiver_seconds_since_previous from hist"""),
)
def seconds_since_previous(spark, sf_dir):
    trails = [Trail(t.keys, seconds=t.seconds) for t in payment_trails() if t.seconds]
    return with_history(_payments(spark, sf_dir, *KEYS), trails).select("txn_id", *[t.seconds for t in trails])


HISTORY = (
    "sender_prior_transaction_count", "sender_prior_total_amount_paid", "sender_seconds_since_previous",
    "receiver_prior_transaction_count", "receiver_prior_total_amount_received", "receiver_seconds_since_previous",
    "pair_prior_transaction_count",
)


@query(
    "history_bundle",
    sql("hist", "select txn_id, " + ", ".join(
        f"round({c}, 6) as {c}" if "count" not in c else c for c in HISTORY) + " from hist"),
)
def history_bundle(spark, sf_dir):
    rows = _payments(spark, sf_dir, *KEYS, "amount_paid", "amount_received")
    return with_history(rows, payment_trails()).select("txn_id", *HISTORY)


@query(
    "history_bundle_two_level",
    sql("hist", "select txn_id, " + ", ".join(
        f"round({c}, 6) as {c}" if "count" not in c else c for c in HISTORY) + " from hist"),
)
def history_bundle_two_level(spark, sf_dir):
    """The plan used for hot keys, forced on every key; rows travel by numeric keys and get their id at the end."""
    keys = binding.KEY_COLUMNS
    columns = dict.fromkeys([*binding.ID_PARTS, *keys.values(), "amount_paid", "amount_received"])
    rows = stage(binding.lines(spark, sf_dir).select(*columns), "payments")
    trails = [replace(t, keys=tuple(keys[k] for k in t.keys)) for t in payment_trails()]
    found = with_history(rows, trails, row_id="l_orderkey", plain_limit=0)
    return found.select(binding.txn_id().alias("txn_id"), *HISTORY)


@query(
    "ledger_history",
    f"""with l as (
      select event_id, ts, user_id, event_type, value from events)
    select event_id, (count(*) over s)::bigint as sender_prior_transaction_count,
      round((coalesce(sum(round(value * 100)::bigint) over s, 0) / 100.0)::double, 6) as sender_prior_total_amount,
      round(((epoch_us(ts) - epoch_us(max(ts) over s)) / 1000000.0)::double, 6) as sender_seconds_since_previous,
      (count(*) over r)::bigint as receiver_prior_transaction_count,
      round((coalesce(sum(round(value * 100)::bigint) over r, 0) / 100.0)::double, 6) as receiver_prior_total_amount,
      round(((epoch_us(ts) - epoch_us(max(ts) over r)) / 1000000.0)::double, 6) as receiver_seconds_since_previous,
      (count(*) over p)::bigint as pair_prior_transaction_count
    from l window s as (partition by user_id order by ts {PAST}), r as (partition by event_type order by ts {PAST}),
      p as (partition by user_id, event_type order by ts {PAST})""",
)
def ledger_history(spark, sf_dir):
    """Single-key histories; event types are few, so each is a hot key."""
    rows = binding.table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").alias("event_time"), F.col("user_id").alias("sender_account_id"),
        F.col("event_type").alias("receiver_account_id"), F.col("value").alias("amount"),
    )
    out = with_history(stage(rows, "ledger"), ledger_trails(), row_id="event_id")
    return out.drop("event_time", "sender_account_id", "receiver_account_id", "amount")


SEMANTIC = (
    "event_hour", "event_day_of_week", "is_weekend", "amount_paid_log", "amount_received_log",
    "amount_relative_difference", "same_currency", "cross_bank",
)


@query(
    "payment_semantics",
    sql("feat", """select txn_id, event_hour, event_day_of_week, is_weekend, round(amount_paid_log, 6) as amount_paid_log,
      round(amount_received_log, 6) as amount_received_log,
      round(amount_relative_difference, 6) as amount_relative_difference, same_currency, cross_bank from feat"""),
)
def payment_semantics(spark, sf_dir):
    return payment_features(binding.transactions(spark, sf_dir)).select("txn_id", *SEMANTIC)


@query(
    "balance_semantics",
    """select o_orderkey, hour(o_orderdate)::int as event_hour, (isodow(o_orderdate) - 1)::int as event_day_of_week,
      (isodow(o_orderdate) >= 6)::int as is_weekend, round(ln(1 + greatest(o_totalprice, 0)), 6) as amount_log,
      round(least(10::double, greatest(0::double,
        coalesce(o_totalprice / greatest(abs(c_acctbal), 2.220446049250313e-16::double), 0))), 6)
        as amount_to_sender_balance_fraction
    from orders join customer on o_custkey = c_custkey""",
)
def balance_semantics(spark, sf_dir):
    orders, customer = (binding.table(spark, sf_dir, t) for t in ("orders", "customer"))
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", F.col("o_orderdate").alias("event_time"), F.col("o_totalprice").alias("amount"),
        F.col("c_acctbal").alias("sender_balance_before"),
    )
    return balance_features(rows).drop("event_time", "amount", "sender_balance_before")


@query(
    "calendar_features",
    """select event_id, hour(ts)::int as event_hour, (isodow(ts) - 1)::int as event_day_of_week,
      (isodow(ts) >= 6)::int as is_weekend from events""",
)
def calendar(spark, sf_dir):
    return binding.table(spark, sf_dir, "events").select(
        "event_id", *[c.alias(n) for n, c in calendar_features(F.col("ts")).items()]
    )


@query(
    "elapsed_features",
    """with e as (select event_id, value, (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) // 1000000 as s from events)
    select event_id, ((s // 3600) % 24)::bigint as transaction_hour, (s // 86400)::bigint as transaction_day,
      round(ln(1 + greatest(value, 0)), 6) as transaction_amount_log from e""",
)
def elapsed(spark, sf_dir):
    events = binding.table(spark, sf_dir, "events")
    seconds = F.floor((F.unix_micros("ts") - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 1_000_000)
    return events.select("event_id", *[c.alias(n) for n, c in elapsed_features(seconds, F.col("value")).items()])


@query(
    "normalized_keys",
    """select p_partkey, case when p_partkey % 3 = 0 then p_partkey::varchar else (p_partkey + 0.5)::varchar end as number_key,
      nullif(trim(case when p_size % 5 = 0 then '   ' else '  ' || p_brand || ' ' end), '') as text_key,
      p_size::varchar as whole_key from part""",
)
def normalized_keys(spark, sf_dir):
    part = binding.table(spark, sf_dir, "part")
    raw = part.select(
        "p_partkey",
        (F.col("p_partkey").cast("double") + F.when(F.col("p_partkey") % 3 == 0, 0.0).otherwise(0.5)).alias("number_key"),
        F.when(F.col("p_size") % 5 == 0, F.lit("   ")).otherwise(F.concat(F.lit("  "), "p_brand", F.lit(" "))).alias("text_key"),
        F.col("p_size").alias("whole_key"),
    )
    return raw.select("p_partkey", *[normalize_key(raw, c).alias(c) for c in ("number_key", "text_key", "whole_key")])


@query(
    "metadata_time",
    "select event_id, epoch_us(ts) as event_micros, true as parsed from events",
)
def metadata_times(spark, sf_dir):
    """Times written into a metadata text and parsed back without evaluating it."""
    t = F.col("ts")
    parts = [F.year(t), F.month(t), F.dayofmonth(t), F.hour(t), F.minute(t), F.second(t),
             F.pmod(F.unix_micros(t), F.lit(1_000_000))]
    text = F.concat(F.lit("{'kind': '"), "event_type", F.lit("', 'at': datetime.datetime("), F.concat_ws(", ", *parts), F.lit(")}"))
    parsed = metadata_time(text)
    return binding.table(spark, sf_dir, "events").select(
        "event_id", F.unix_micros(parsed).alias("event_micros"), parsed.isNotNull().alias("parsed")
    )


@query(
    "derived_recompute",
    sql("txn", """, base as (select txn_id, amount_paid * 2 as p, amount_received as r, sender_balance_before as b from txn)
      select txn_id, round(ln(1 + greatest(p, 0)), 6) as amount_paid_log,
        round(abs(p - r) / (abs(p) + abs(r) + 2.220446049250313e-16::double), 6) as amount_relative_difference,
        round(least(10::double, greatest(0::double, p / greatest(abs(b), 2.220446049250313e-16::double))), 6)
          as amount_to_sender_balance_fraction from base"""),
)
def derived_recompute(spark, sf_dir):
    """Derived features after the paid amount is changed, from declared formulas."""
    specs = [
        {"output": "amount_paid_log", "formula": "log1p_nonnegative", "inputs": ["amount_paid"]},
        {"output": "amount_relative_difference", "formula": "absolute_relative_difference",
         "inputs": ["amount_paid", "amount_received"]},
        {"output": "amount_to_sender_balance_fraction", "formula": "amount_to_absolute_balance_fraction",
         "inputs": ["amount_paid", "sender_balance_before"]},
    ]
    values = {c: F.col(c) for c in ("amount_received", "sender_balance_before")}
    values["amount_paid"] = F.col("amount_paid") * 2
    out = counterfactual.recomputed(values, specs)
    return binding.transactions(spark, sf_dir).select("txn_id", *[out[s["output"]].alias(s["output"]) for s in specs])


@query(
    "denylist_projection",
    sql("txn", """select txn_id, sender_bank_id, sender_account_id, receiver_bank_id, receiver_account_id, amount_paid,
      amount_received, payment_currency, receiving_currency, payment_format, sender_balance_before from txn"""),
)
def denylist_projection(spark, sf_dir):
    rows = binding.transactions(spark, sf_dir)
    kept = contracts.feature_columns(rows.columns, contracts.PAYMENT_DENYLIST)
    contracts.require_no_leakage(kept, contracts.PAYMENT_DENYLIST)
    return rows.select("txn_id", *kept)


@query(
    "feature_profile",
    sql("hist", " union all ".join(
        f"""select '{c}' as "column", round(avg(({c} is null)::int), 6) as missing_fraction,
          count(distinct {c})::bigint as distinct_values from hist"""
        for c in ("amount_paid", "payment_format", "sender_seconds_since_previous", "receiver_account_id"))),
)
def feature_profile(spark, sf_dir):
    """Missing share and exact distinct count per column."""
    rows = binding.featured(spark, sf_dir)
    names = ["amount_paid", "payment_format", "sender_seconds_since_previous", "receiver_account_id"]
    return preprocess.column_profile(rows.select(*names), names)


@query(
    "feature_eligibility",
    """with p as (
      select 'amount_paid' as f, true as num, avg((l_extendedprice is null)::int) as miss, count(distinct l_extendedprice) as d from lineitem
      union all select 'flag', false, avg((l_returnflag is null)::int), count(distinct l_returnflag) from lineitem
      union all select 'constant', true, 0, 1 from lineitem
      union all select 'mostly_missing', true, avg((l_quantity <> 1)::int), 1 from lineitem
      union all select 'order', false, 0, count(distinct l_orderkey) from lineitem
      union all select 'sometimes', true, avg((l_discount >= 0.05)::int),
        count(distinct case when l_discount < 0.05 then l_quantity end) from lineitem)
    select f as feature, (row_number() over (order by miss, f))::int as place
    from (select f, any_value(num) as num, any_value(miss) as miss, any_value(d) as d from p group by f)
    where miss <= 0.95 and d > 1 and (num or d <= 100)""",
)
def feature_eligibility(spark, sf_dir):
    rows = binding.table(spark, sf_dir, "lineitem").select(
        F.col("l_extendedprice").alias("amount_paid"),
        F.col("l_returnflag").alias("flag"),
        F.lit(1).alias("constant"),
        F.when(F.col("l_quantity") == 1, F.lit(1)).alias("mostly_missing"),
        F.col("l_orderkey").cast("string").alias("order"),
        F.when(F.col("l_discount") < 0.05, F.col("l_quantity")).alias("sometimes"),
    )
    names = preprocess.eligible_features(rows, rows.columns, max_categories=100)
    return spark.createDataFrame([(f, i + 1) for i, f in enumerate(names)], "feature string, place int")


# --- joins -----------------------------------------------------------------------------------


@query(
    "profile_join_coverage",
    """with prof as (
      select c_nationkey::varchar as bank, c_custkey::varchar as acct from customer where c_acctbal >= 0
      union all select s_nationkey::varchar, 'S' || s_suppkey from supplier)
    select count(*) as rows, round(avg((a.acct is not null)::int), 6) as sender_coverage,
      round(avg((b.acct is not null)::int), 6) as receiver_coverage
    from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
      join supplier on l_suppkey = s_suppkey
      left join prof a on a.bank = c_nationkey::varchar and a.acct = c_custkey::varchar
      left join prof b on b.bank = s_nationkey::varchar and b.acct = 'S' || s_suppkey""",
)
def profile_join_coverage(spark, sf_dir):
    """Two profile tables joined once for senders and once for receivers."""
    customer, supplier = (binding.table(spark, sf_dir, t) for t in ("customer", "supplier"))
    files = {
        "person": customer.filter("c_acctbal >= 0").select(
            F.col("c_nationkey").alias("bank"), F.col("c_custkey").alias("bank_account_number"), "c_mktsegment"),
        "merchant": supplier.select(
            F.col("s_nationkey").alias("bank"), F.concat(F.lit("S"), "s_suppkey").alias("bank_account_number"), "s_name"),
    }
    keys = ("bank", "bank_account_number")
    profiles = joins.combine_profiles(files, keys)
    rows = binding.transactions(spark, sf_dir).select(
        "txn_id", "sender_bank_id", "sender_account_id", "receiver_bank_id",
        F.concat(F.lit("S"), "receiver_account_id").alias("receiver_account_id"),
    )
    roles = {r: (f"{r}_bank_id", f"{r}_account_id") for r in ("sender", "receiver")}
    return joins.profile_coverage(joins.join_profiles(rows, profiles, keys, roles), list(roles))


@query(
    "identity_join_coverage",
    """with big as (select o_custkey, count(*) as large_orders from orders where o_totalprice >= 300000 group by 1)
    select count(*) as rows, round(avg((o_custkey is not null)::int), 6) as coverage,
      coalesce(sum(large_orders), 0)::bigint as large_orders
    from customer left join big on c_custkey = o_custkey""",
)
def identity_join_coverage(spark, sf_dir):
    customer, orders = (binding.table(spark, sf_dir, t) for t in ("customer", "orders"))
    large = orders.filter("o_totalprice >= 300000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("large_orders"))
    joined = joins.identity_join(customer, large, "c_custkey")
    return joined.agg(
        F.count(F.lit(1)).alias("rows"), F.avg(F.col("has_identity").cast("double")).alias("coverage"),
        F.coalesce(F.sum("large_orders"), F.lit(0)).alias("large_orders"),
    )


@query(
    "checked_left_join",
    """select p_brand, count(*) as lines, round((sum(round(l_extendedprice * 100)::bigint) / 100.0)::double, 6) as amount
    from lineitem left join part on l_partkey = p_partkey group by 1""",
)
def checked_left_join(spark, sf_dir):
    line = binding.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_extendedprice")
    part = binding.table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    joined = joins.checked_join(line, part, ["p_partkey"], how="left", validate="m:1")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return joined.groupBy("p_brand").agg(F.count(F.lit(1)).alias("lines"), (F.sum(cents) / 100.0).alias("amount"))


@query(
    "membership_filters",
    """with building as (select c_custkey from customer where c_mktsegment = 'BUILDING')
    select o_orderpriority, sum((o_custkey in (select c_custkey from building))::int)::bigint as inside,
      sum((o_custkey not in (select c_custkey from building))::int)::bigint as outside from orders group by 1""",
)
def membership_filters(spark, sf_dir):
    orders = binding.table(spark, sf_dir, "orders").select("o_orderpriority", F.col("o_custkey").alias("c_custkey"))
    members = binding.table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'")
    a = joins.only_in(orders, members, ["c_custkey"]).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("inside"))
    b = joins.not_in(orders, members, ["c_custkey"]).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("outside"))
    # One row per priority on both sides.
    return a.join(b, "o_orderpriority", "full_outer").na.fill(0)


@query(
    "time_group_sets",
    """with a as (select distinct date_trunc('month', l_shipdate) as m from lineitem),
      b as (select distinct date_trunc('month', o_orderdate) as m from orders)
    select coalesce(a.m, b.m)::date::varchar as month,
      case when b.m is null then 'shipped only' when a.m is null then 'ordered only' else 'both' end as kind
    from a full join b on a.m = b.m""",
)
def time_group_sets(spark, sf_dir):
    def months(name, column):
        return binding.table(spark, sf_dir, name).select(F.date_trunc("month", column).cast("date").cast("string").alias("month"))

    shipped, ordered = months("lineitem", "l_shipdate"), months("orders", "o_orderdate")
    return (
        joins.shared_groups(shipped, ordered, "month").withColumn("kind", F.lit("both"))
        .unionByName(joins.missing_groups(shipped, ordered, "month").withColumn("kind", F.lit("shipped only")))
        .unionByName(joins.missing_groups(ordered, shipped, "month").withColumn("kind", F.lit("ordered only")))
    )


# --- splits and samples ----------------------------------------------------------------------


@query(
    "temporal_split_rows",
    sql("txn", """, r as (select txn_id, row_number() over (order by event_time, md5(txn_id)) as k, count(*) over () as n from txn)
      select txn_id, case when k <= floor(n * 0.6::double) then 'train'
        when k <= floor(n * (0.6::double + 0.2::double)) then 'validation' else 'test' end as split from r"""),
)
def temporal_split_rows(spark, sf_dir):
    rows = binding.transactions(spark, sf_dir).select("txn_id", "event_time")
    out = splits.temporal_rows_split(rows, (0.6, 0.2, 0.2), time="event_time", row_id="txn_id")
    return out.select("txn_id", "split")


@query("timestamp_safe_split", sql("roled", "select txn_id, role, split from roled"))
def timestamp_safe_split(spark, sf_dir):
    rows = stage(binding.transactions(spark, sf_dir).select("txn_id", "event_time"), "times")
    return splits.with_roles(rows, splits.timestamp_safe_cuts(rows.select("event_time"))).select("txn_id", "role", "split")


@query(
    "time_group_split",
    """select o_orderkey, case when year(o_orderdate) <= (select min(year(o_orderdate)) + 3 from orders) then 'train'
      when year(o_orderdate) = (select max(year(o_orderdate)) from orders) then 'test' else 'validation' end as split
    from orders""",
)
def time_group_split(spark, sf_dir):
    orders = binding.table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    years = sorted(r["year"] for r in orders.select("year").distinct().collect())
    groups = {"train": [y for y in years if y <= years[0] + 3], "test": [years[-1]]}
    groups["validation"] = [y for y in years if y not in groups["train"] and y not in groups["test"]]
    return splits.time_group_split(orders, groups, time="year").select("o_orderkey", "split")


@query(
    "stratified_split",
    sql("txn", """, r as (select txn_id, label, row_number() over (partition by label order by md5('42|' || txn_id)) as k,
        count(*) over (partition by label) as n from txn)
      select txn_id, label, case when k <= floor(n * 0.6::double) then 'train'
        when k <= floor(n * (0.6::double + 0.2::double)) then 'validation' else 'test' end as split from r"""),
)
def stratified_split(spark, sf_dir):
    rows = binding.transactions(spark, sf_dir).select("txn_id", "label")
    return splits.stratified_split(rows, (0.6, 0.2, 0.2), target="label", row_id="txn_id").select("txn_id", "label", "split")


@query(
    "chronological_thirds",
    """with r as (select event_id, row_number() over (order by ts, md5(event_id::varchar)) as k, count(*) over () as n from events)
    select event_id, case when k <= floor(n * 0.4::double) then 'calibrator_fit'
      when k <= floor(n * (0.4::double + 0.3::double)) then 'calibrator_selection' else 'threshold_selection' end as partition
    from r""",
)
def chronological_thirds(spark, sf_dir):
    rows = binding.table(spark, sf_dir, "events").select("event_id", "ts")
    return splits.chronological_thirds(rows, time="ts", row_id="event_id").select("event_id", "partition")


@query(
    "chronological_halves",
    """with r as (select event_id, row_number() over (order by ts, md5(event_id::varchar)) as k, count(*) over () as n from events)
    select event_id, case when k <= n // 2 then 'fit' else 'select' end as partition from r""",
)
def chronological_halves(spark, sf_dir):
    rows = binding.table(spark, sf_dir, "events").select("event_id", "ts")
    return splits.chronological_halves(rows, time="ts", row_id="event_id").select("event_id", "partition")


@query(
    "split_groups",
    """with o as (select date_trunc('month', o_orderdate)::date as m, case when o_orderpriority < '3' then 'urgent' else 'other' end as split from orders),
      g as (select m, split, count(*) as rows from o where m is not null group by 1, 2)
    select m::varchar as time_group, split, rows, (count(*) over (partition by m) > 1) as shared from g""",
)
def split_groups(spark, sf_dir):
    """Months of orders under two overlapping splits."""
    orders = binding.table(spark, sf_dir, "orders").select(
        F.to_date(F.date_trunc("month", "o_orderdate")).cast("string").alias("m"),
        F.when(F.col("o_orderpriority") < "3", "urgent").otherwise("other").alias("split"),
    )
    return splits.split_groups(orders, time="m")


@query(
    "split_integrity",
    """, g as (select event_time::date as g, split, count(*) as n from roled group by 1, 2),
      s as (select g, count(*) as k from g group by 1)
    select split, sum(n)::bigint as rows, min(g.g)::varchar as time_min, max(g.g)::varchar as time_max,
      count(*)::bigint as time_group_count, (max(k) = 1) as group_disjoint
    from g join s on g.g = s.g group by 1""",
)
def split_integrity(spark, sf_dir):
    audit = binding.audit(spark, sf_dir)
    days = audit.rows.select("split", F.to_date("event_time").alias("day"))
    out = splits.split_integrity(days, time="day")
    return out.select(
        "split", "rows", F.col("time_min").cast("string").alias("time_min"),
        F.col("time_max").cast("string").alias("time_max"), "time_group_count", "group_disjoint",
    )


REQUESTED = {"train": 0.6, "calibration_fit": 0.05, "calibration_select": 0.05, "rule_audit": 0.05,
             "policy_select": 0.05, "test": 0.2}


@query(
    "partition_table",
    """select role, count(*) as rows, sum(label)::bigint as positives, round(avg(label), 6) as positive_rate,
      epoch_us(min(event_time)) as time_min, epoch_us(max(event_time)) as time_max, min(label) <> max(label) as both_classes,
      case role when 'train' then 0.6::double when 'test' then 0.2::double else 0.05::double end as requested_share,
      round(count(*) / (select count(*) from roled), 6) as observed_share from roled group by 1""",
)
def partition_table(spark, sf_dir):
    audit = binding.audit(spark, sf_dir)
    splits.require_both_classes(audit.rows, role="role", target="label")
    out = splits.partition_table(audit.rows, REQUESTED, role="role", target="label")
    return out.withColumns({c: F.unix_micros(c) for c in ("time_min", "time_max")})


@query(
    "systematic_sample",
    """with r as (select event_id, row_number() over (order by ts, md5(event_id::varchar)) - 1 as k, count(*) over () as n from events),
      p as (select (i * (n - 1)) // 499 as k from (select n from r limit 1), range(500) t(i))
    select event_id from r where n <= 500 or k in (select k from p)""",
)
def systematic_sample(spark, sf_dir):
    rows = binding.table(spark, sf_dir, "events").select("event_id", "ts")
    return sampling.systematic_sample(rows, 500, time="ts", row_id="event_id").select("event_id")


@query(
    "group_capped_sample",
    """with r as (select event_id, event_type, row_number() over (partition by event_type order by md5('42|' || event_id)) as k
        from events),
      g as (select event_type, row_number() over (order by event_type) - 1 as i, count(*) over () as g
        from (select distinct event_type from events))
    select event_id, event_type from r join g using (event_type)
    where k <= 503 // g + (case when i < 503 % g then 1 else 0 end)""",
)
def group_capped_sample(spark, sf_dir):
    rows = binding.table(spark, sf_dir, "events").select("event_id", "event_type")
    return sampling.group_quota_sample(rows, "event_type", 503, row_id="event_id").select("event_id", "event_type")


@query(
    "time_bin_rates",
    sql("txn", """, r as (select *, row_number() over (order by event_time, md5(txn_id)) - 1 as k, count(*) over () as n from txn)
      select greatest(1, (k * 12 + n - 2) // (n - 1))::int as time_bin, epoch_us(min(event_time)) as start_time,
        epoch_us(max(event_time)) as end_time, count(*) as rows, sum(label)::bigint as positives,
        round(avg(label), 6) as positive_rate from r group by 1"""),
)
def time_bin_rates(spark, sf_dir):
    out = profile.rate_by_time_bin(binding.transactions(spark, sf_dir), "event_time", "label", "txn_id")
    return out.withColumns({c: F.unix_micros(c) for c in ("start_time", "end_time")})


@query(
    "group_rates",
    """select ts::date::varchar as period, count(*) as rows,
      sum((event_type = 'error')::int)::bigint as positives, round(avg((event_type = 'error')::int), 6) as positive_rate
    from events group by 1""",
)
def group_rates(spark, sf_dir):
    rows = binding.table(spark, sf_dir, "events").select("ts", (F.col("event_type") == "error").cast("int").alias("label"))
    return profile.rate_by_group(rows, F.to_date("ts").cast("string"), "label")


@query(
    "missingness_profile",
    sql("hist", " union all ".join(
        f"""select count(*) as rows, '{c}' as "column", sum(({c} is null)::int)::bigint as missing_cells,
          {f"sum(({c} = {s})::int)::bigint" if s is not None else "0::bigint"} as sentinel_cells,
          round(avg(({c} is null)::int), 6) as missing_rate,
          {f"round(avg(coalesce(({c} = {s})::int, 0)), 6)" if s is not None else "0::double"} as sentinel_rate from hist"""
        for c, s in (("sender_seconds_since_previous", 86400), ("receiver_seconds_since_previous", 0),
                     ("amount_paid", None), ("pair_prior_transaction_count", 0)))),
)
def missingness_profile(spark, sf_dir):
    """Native missing cells against sentinel cells."""
    sentinels = {"sender_seconds_since_previous": 86400.0, "receiver_seconds_since_previous": 0.0,
                 "pair_prior_transaction_count": 0.0}
    names = ["sender_seconds_since_previous", "receiver_seconds_since_previous", "amount_paid", "pair_prior_transaction_count"]
    return profile.missingness(binding.featured(spark, sf_dir), names, sentinels)


# SQL that starts with a comma, or reads ``roled``, follows the shared steps.
def _complete() -> None:
    from riskloom.plans.registry import ORACLES

    ORACLES["split_integrity"] = sql("roled", ORACLES["split_integrity"])
    ORACLES["partition_table"] = sql("roled", ORACLES["partition_table"])


_complete()
