"""Generated fixtures for tests: pure functions of the row number, so they scale and repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.hashing import uniform

START = "2025-01-01 00:00:00"


def _u(name: str, seed: int) -> Column:
    return uniform(F.lit(name), F.lit(seed), F.col("id"))


def _pick(values: list[str | None], u: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(u * len(values)) + 1).cast("int"))


def _time(seconds: Column) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(F.lit(START)) + seconds)


def card_transactions(spark: SparkSession, rows: int, seed: int = 42) -> DataFrame:
    """Card transactions whose fraud chance rises with amount, count and night hours."""
    dt = F.col("id") * 311 + F.floor(_u("dt", seed) * 300)
    amount = F.exp(3.5 + F.sqrt(-2 * F.log(F.greatest(_u("a", seed), F.lit(1e-9)))) * F.cos(6.283185307179586 * _u("b", seed)))
    count = F.floor(-2 * F.log(1 - _u("c", seed))).cast("bigint")
    hour = F.pmod(F.floor(dt / 3600), F.lit(24))
    chance = 1 / (1 + F.exp(-(-4.0 + 0.012 * amount + 0.25 * count + F.when(hour < 6, 0.8).otherwise(0.0))))
    return spark.range(rows).select(
        F.col("id").alias("TransactionID"),
        dt.cast("bigint").alias("TransactionDT"),
        amount.alias("TransactionAmt"),
        count.alias("C1"),
        (F.floor(_u("card", seed) * 1000) + 1000).cast("string").alias("card1"),
        _pick(["desktop", "mobile", None], _u("dev", seed)).alias("DeviceType"),
        _pick(["mail.test", "post.test", "box.test", None], _u("dom", seed)).alias("P_emaildomain"),
        (_u("y", seed) < chance).cast("int").alias("isFraud"),
    )


def card_identity(spark: SparkSession, rows: int, seed: int = 42) -> DataFrame:
    return spark.range(rows).filter(F.col("id") % 2 == 0).select(
        F.col("id").alias("TransactionID"), _pick(["desktop", "mobile"], _u("idev", seed)).alias("id_device")
    )


def applications(spark: SparkSession, rows: int, seed: int = 42) -> DataFrame:
    """Account applications over eight months; -1 is a kept sentinel."""
    velocity = _u("v", seed) * 9000
    risk = _u("r", seed) * 400 - 100
    foreign = (_u("f", seed) < 0.15).cast("int")
    chance = 1 / (1 + F.exp(-(-4.2 + 0.008 * risk + 1.2 * foreign)))
    return spark.range(rows).select(
        F.col("id").alias("row_id"),
        F.pmod(F.col("id"), F.lit(8)).alias("month"),
        velocity.alias("velocity_6h"),
        F.floor(_u("e", seed) * 3).cast("int").alias("device_distinct_emails_8w"),
        foreign.alias("foreign_request"),
        F.when(_u("sl", seed) < 0.05, F.lit(-1.0)).otherwise(_u("s", seed) * 60).alias("session_length_in_minutes"),
        (F.floor(_u("l", seed) * 10) * 200).cast("int").alias("proposed_credit_limit"),
        (F.floor(_u("g", seed) * 8) * 10 + 10).cast("int").alias("customer_age"),
        _u("i", seed).alias("income"),
        risk.alias("credit_risk_score"),
        _pick(["AA", "AB", "AC", "AD", "AE"], _u("p", seed)).alias("payment_type"),
        _pick(["CA", "CB", "CC", "CD", "CE", "CF", "CG"], _u("m", seed)).alias("employment_status"),
        (_u("y", seed) < chance).cast("int").alias("fraud_bool"),
    )


def payments(spark: SparkSession, rows: int) -> DataFrame:
    """Payments in raw headers; pairs of rows share a timestamp."""
    i = F.col("id")
    sender = F.pmod(i, F.lit(12))
    receiver = F.pmod(sender + 3, F.lit(12))
    amount = 100.0 + F.pmod(i * 37, F.lit(1000))
    return spark.range(rows).select(
        F.date_format(_time(F.floor(i / 2) * 60), "yyyy-MM-dd HH:mm:ss").alias("Timestamp"),
        F.pmod(sender, F.lit(3)).cast("string").alias("From Bank"),
        F.concat(F.lit("S"), sender).alias("From Account"),
        F.pmod(receiver, F.lit(3)).cast("string").alias("To Bank"),
        F.concat(F.lit("S"), receiver).alias("To Account"),
        amount.alias("Amount Received"),
        F.lit("EUR").alias("Receiving Currency"),
        (amount * F.when(i % 5 == 0, 1.02).otherwise(1.0)).alias("Amount Paid"),
        F.when(i % 5 == 0, "USD").otherwise("EUR").alias("Payment Currency"),
        _pick(["Wire", "Card", "Cash"], uniform(F.lit("fmt"), "id")).alias("Payment Format"),
        (i % 7 == 0).cast("int").alias("Is Laundering"),
    )


def payment_profiles(spark: SparkSession) -> dict[str, DataFrame]:
    """Person and merchant profiles that together cover all twelve accounts once."""
    account = spark.range(12).select(
        F.pmod(F.col("id"), F.lit(3)).cast("string").alias("bank"),
        F.concat(F.lit("S"), F.col("id")).alias("bank_account_number"),
        F.col("id"),
    )
    person = account.filter("id < 6").select(
        F.concat(F.lit("P"), "id").alias("person_id"), "bank_account_number", "bank",
        (F.col("id") + 30).alias("person_age"),
    )
    merchant = account.filter("id >= 6").select(
        F.concat(F.lit("M"), "id").alias("merchant_id"), "bank_account_number", "bank", F.lit("retail").alias("industry")
    )
    return {"person": person, "merchant": merchant}


def ledger(spark: SparkSession, rows: int) -> DataFrame:
    """Ledger rows with the time inside a metadata text."""
    i = F.col("id")
    t = _time(F.floor(i / 2) * 3600)
    parts = [F.year(t), F.month(t), F.dayofmonth(t), F.hour(t), F.minute(t), F.second(t), F.pmod(i, F.lit(1000))]
    text = F.concat(F.lit("{'ts': datetime.datetime("), F.concat_ws(", ", *parts), F.lit(")}"))
    amount = 50.0 + F.pmod(i * 53, F.lit(2000))
    return spark.range(rows).select(
        i.alias("step"),
        _pick(["TRANSFER", "PAYMENT", "CASH_OUT"], uniform(F.lit("type"), "id")).alias("type"),
        amount.alias("amount"),
        _pick(["food", "rent", "other"], uniform(F.lit("cat"), "id")).alias("category"),
        F.concat(F.lit("C"), F.pmod(i, F.lit(10))).alias("nameOrig"),
        F.concat(F.lit("D"), F.pmod(i, F.lit(7))).alias("nameDest"),
        (amount * 3).alias("oldbalanceOrg"),
        (amount * 2).alias("newbalanceOrig"),
        (i % 11 == 0).cast("int").alias("isFraud"),
        (i % 7 == 0).cast("int").alias("isMoneyLaundering"),
        F.when(i % 7 == 0, "layering").otherwise("none").alias("laundering_typology"),
        text.alias("metadata"),
        uniform(F.lit("fp"), "id").alias("fraud_probability"),
        F.hour(t).alias("hour"),
        F.weekday(t).alias("day_of_week"),
        F.dayofmonth(t).alias("day_of_month"),
        F.month(t).alias("month"),
    )
