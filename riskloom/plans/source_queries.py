"""Loaders and sinks, fed with columns of the driver tables under raw headers."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import audit as audit_ops
from riskloom.operators import profile, rules
from riskloom.plans import binding
from riskloom.plans.audit_queries import ATTRIBUTED, AUDITED, STATS, audited
from riskloom.plans.binding import RULES
from riskloom.plans.feature_queries import HISTORY
from riskloom.plans.oracle import sql
from riskloom.plans.registry import query
from riskloom.session import checkpoint_root
from riskloom.sources import artifacts, readers


def folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark)}/{name}-{uuid4().hex}"


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binding.table(spark, sf_dir, "orders")


@query("csv_scan", "select o_orderkey, o_orderpriority, round(o_totalprice, 6) as o_totalprice from orders")
def csv_scan(spark, sf_dir):
    """Orders written as CSV and read with a declared schema."""
    path = folder(spark, "orders-csv")
    artifacts.write_table(orders(spark, sf_dir).select("o_orderkey", "o_orderpriority", "o_totalprice"), path, form="csv")
    return readers.read_table(spark, path, schema="o_orderkey bigint, o_orderpriority string, o_totalprice double", form="csv")


@query(
    "card_load",
    """select o_orderkey as transaction_id, (epoch_us(o_orderdate) // 1000000 // 3600 % 24)::bigint as transaction_hour,
      (epoch_us(o_orderdate) // 1000000 // 86400)::bigint as transaction_day, round(ln(1 + greatest(o_totalprice, 0)), 6) as transaction_amount_log,
      case when o_orderkey % 2 = 0 then o_orderstatus end as device, (o_orderpriority = '1-URGENT')::int as is_fraud from orders""",
)
def card_load(spark, sf_dir):
    """Orders as card transactions; every second one has an identity row."""
    rows = orders(spark, sf_dir)
    cards = rows.select(
        F.col("o_orderkey").alias("TransactionID"), F.unix_seconds("o_orderdate").alias("TransactionDT"), F.col("o_totalprice").alias("TransactionAmt"),
        (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("isFraud"),
    )
    identity = rows.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("TransactionID"), F.col("o_orderstatus").alias("DeviceType"))
    return readers.load_card_transactions(cards, identity).select(
        F.col("TransactionID").alias("transaction_id"), "transaction_hour", "transaction_day", "transaction_amount_log", F.col("DeviceType").alias("device"),
        F.col("isFraud").cast("int").alias("is_fraud"),
    )


@query(
    "application_load",
    "select c_nationkey % 8 as month, count(*) as rows, sum((c_acctbal < 0)::int)::bigint as positives from customer group by 1",
)
def application_load(spark, sf_dir):
    """Customers as account applications."""
    rows = binding.table(spark, sf_dir, "customer").select(
        "c_custkey", (F.col("c_nationkey") % 8).alias("month"), (F.col("c_acctbal") < 0).cast("int").alias("fraud_bool")
    )
    return readers.load_applications(rows).groupBy("month").agg(F.count(F.lit(1)).alias("rows"), F.sum("fraud_bool").alias("positives"))


@query(
    "payment_load",
    sql("feat", "select txn_id, label, cross_bank, same_currency, round(amount_relative_difference, 6) as amount_relative_difference, "
        + ", ".join(c if "count" in c else f"round({c}, 6) as {c}" for c in HISTORY) + " from feat"),
)
def payment_load(spark, sf_dir):
    """Order lines under raw payment headers."""
    names = {v: k for k, v in readers.PAYMENT_COLUMNS.items() if k not in ("Account", "Account.1")}
    raw = binding.transactions(spark, sf_dir).withColumn("event_time", F.col("event_time").cast("string"))
    loaded = readers.load_payments(raw.withColumnsRenamed(names).drop("sender_balance_before"))
    return loaded.select("txn_id", F.col("label").cast("int").alias("label"), "cross_bank", "same_currency", "amount_relative_difference", *HISTORY)


@query(
    "ledger_load",
    """select event_id, hour(ts)::int as event_hour, round(ln(1 + greatest(value, 0)), 6) as amount_log,
      round(case when user_id % 7 = 0 then 0.0 else least(10, greatest(0, value / greatest(abs(user_id % 7), 2.220446049250313e-16::double))) end, 6)
        as amount_to_sender_balance_fraction, (count(*) over (partition by user_id order by ts
        range between unbounded preceding and interval 1 microsecond preceding))::bigint as sender_prior_transaction_count
    from events where value is not null""",
)
def ledger_load(spark, sf_dir):
    """Events as ledger rows whose time stands in metadata text."""
    parts = ("year(ts)", "month(ts)", "day(ts)", "hour(ts)", "minute(ts)", "second(ts)", "unix_micros(ts) % 1000000")
    stamp = F.concat_ws(", ", *[F.expr(p).cast("string") for p in parts])
    raw = binding.table(spark, sf_dir, "events").where("value is not null").select(
        F.col("event_id").cast("string").alias("txn_id"), F.col("value").alias("amount"), F.col("user_id").cast("string").alias("nameOrig"),
        F.col("event_type").alias("nameDest"), F.nullif(F.col("user_id") % 7, F.lit(0)).cast("double").alias("oldbalanceOrg"),
        F.concat(F.lit("{'t': datetime.datetime("), stamp, F.lit(")}")).alias("metadata"),
        (F.col("event_type") == "error").cast("int").alias("isMoneyLaundering"),
    )
    out = readers.load_ledger(raw)
    return out.select(F.col("txn_id").cast("bigint").alias("event_id"), "event_hour", "amount_log", "amount_to_sender_balance_fraction", "sender_prior_transaction_count")


@query("canonical_columns", "select o_orderkey as txn_id, round(o_totalprice, 6) as amount, o_orderstatus as status from orders")
def canonical_columns(spark, sf_dir):
    """Raw headers renamed; the custom pair is given in the other direction."""
    raw = orders(spark, sf_dir).select("o_orderkey", "o_totalprice", "o_orderstatus")
    mapping = readers.effective_columns(raw.columns, {"o_orderkey": "txn_id", "o_totalprice": "amount"}, {"status": "o_orderstatus"})
    return readers.canonical(raw, mapping, ("txn_id", "amount", "status"))


@query("output_lineage", "select 'late_orders' as output, count(*) as rows from orders where o_orderstatus = 'F'")
def output_lineage(spark, sf_dir):
    """Of two written outputs one is altered afterwards; the lineage names it."""
    path, rows = folder(spark, "outputs"), orders(spark, sf_dir).select("o_orderkey", "o_orderstatus", "o_totalprice")
    lineage = artifacts.write_outputs({"all_orders": rows, "late_orders": rows.where("o_orderstatus = 'F'")}, path)
    artifacts.write_table(rows.where("o_orderstatus = 'F'").withColumn("o_totalprice", F.col("o_totalprice") + 1), f"{path}/late_orders")
    changed = artifacts.changed_outputs(spark, path)
    return lineage.where(F.col("output").isin(changed)).select("output", "rows")


@query(
    "table_sinks",
    """select f.form, o_orderstatus, count(*) as rows, round(sum(o_totalprice), 2) as total
    from orders, (values ('csv'), ('json'), ('orc'), ('parquet')) f(form) group by 1, 2""",
)
def table_sinks(spark, sf_dir):
    """The same rows through every sink, partitioned by status, and back."""
    rows = orders(spark, sf_dir).select("o_orderkey", "o_totalprice", "o_orderstatus")
    out = None
    for form in ("csv", "json", "orc", "parquet"):
        path = folder(spark, f"sink-{form}")
        artifacts.write_table(rows, path, form=form, by=["o_orderstatus"])
        reader = spark.read.schema("o_orderkey bigint, o_totalprice double, o_orderstatus string").option("header", True)
        part = reader.format(form).load(path).withColumn("form", F.lit(form))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("form", "o_orderstatus").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(
    "collected_reports",
    """select run, o_orderpriority as name, count(*)::varchar as value,
      case when run = 'run_f' then '1' end as extra
    from (select case when o_orderstatus = 'F' then 'run_f' else 'run_other' end as run, o_orderpriority from orders) group by 1, 2""",
)
def collected_reports(spark, sf_dir):
    """Metric files of two runs; one has a column more."""
    path, rows = folder(spark, "runs"), orders(spark, sf_dir)
    for run, chosen in (("run_f", F.col("o_orderstatus") == "F"), ("run_other", F.col("o_orderstatus") != "F")):
        table = rows.where(chosen).groupBy(F.col("o_orderpriority").alias("name")).agg(F.count(F.lit(1)).alias("value"))
        artifacts.write_table(table.withColumn("extra", F.lit("1")) if run == "run_f" else table, f"{path}/{run}", form="csv")
    return readers.collect_reports(spark, [f"{path}/run_f", f"{path}/run_other"]).select("run", "name", "value", "extra")


@query(
    "json_safe_report",
    """select l_returnflag, round(avg(l_discount), 6) as mean, null::double as not_a_number, null::double as infinite,
      case when l_returnflag = 'R' then null::double else 1.0::double end as sometimes from lineitem group by 1""",
)
def json_safe_report(spark, sf_dir):
    """NaN and infinite report values become null."""
    report = binding.table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.avg("l_discount").alias("mean"))
    values = {"not_a_number": F.lit(float("nan")), "infinite": F.lit(float("-inf")), "sometimes": F.when(F.col("l_returnflag") == "R", float("inf")).otherwise(1.0)}
    return artifacts.json_safe(report.withColumns(values))


@query(
    "candidate_counts",
    f"""select tier, source, count(*) as candidates from (values {', '.join(f"('A', 'configured', '{r['name']}')" for r in RULES)},
      ('C', 'generated', 'generated_amount')) v(tier, source, rule) group by 1, 2""",
)
def candidate_counts(spark, sf_dir):
    train = binding.audit(spark, sf_dir).part("train")
    own = rules.rule_registry(spark, RULES, rules.fit_rules(train, RULES, "label"), tier="A")
    extra = [{"name": "generated_amount", "conditions": [{"feature": "amount_paid", "operator": "greater_quantile", "value": 0.9}]}]
    made = rules.rule_registry(spark, extra, rules.fit_rules(train, extra, "label"), tier="C", source="generated")
    return profile.candidate_counts(rules.combine_registries(own, made))


@query(
    "audit_order",
    sql("truth", "select row_number() over (order by (failures = '') desc, score desc, rule)::int as place, rule from audited", STATS, ATTRIBUTED, AUDITED),
)
def audit_order(spark, sf_dir):
    """Rules by audit result, then score, then name: one row per rule."""
    ordered = audit_ops.audit_order(audited(spark, sf_dir).table).select("rule").collect()
    return spark.createDataFrame([(i + 1, r["rule"]) for i, r in enumerate(ordered)], "place int, rule string")


@query(
    "rule_lists_as_text",
    """with o as (select o_custkey, to_json(list(distinct o_orderpriority order by o_orderpriority)) as rules from orders group by 1)
    select o_custkey, rules::varchar as rules, json_array_length(rules)::int as n from o""",
)
def rule_lists_as_text(spark, sf_dir):
    """Lists of names as JSON text, and read back."""
    lists = orders(spark, sf_dir).groupBy("o_custkey").agg(F.sort_array(F.collect_set("o_orderpriority")).alias("names"))
    text = lists.select("o_custkey", F.to_json("names").alias("rules"))
    return text.withColumn("n", F.size(F.from_json("rules", "array<string>")))
