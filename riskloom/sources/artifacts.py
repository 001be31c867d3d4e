"""Manifests, order-free fingerprints, and the hand-off of scored tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.hashing import row_fingerprint
from riskloom.functions.keys import finite_or_null
from riskloom.operators.profile import exact_duplicates
from riskloom.session import with_constants


def table_fingerprint(df: DataFrame, columns: Sequence[str] | None = None, *, by: Sequence[str] = ()) -> DataFrame:
    """Row count and two digest sums: equal for equal tables whatever the row order or partitioning."""
    names = list(columns or df.columns)
    # Decimal sums: the digests of a very large table overflow a long.
    sums = [F.sum(n.cast("decimal(20,0)")).cast("string") for n in row_fingerprint(*[F.col(c) for c in names])]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.concat_ws(":", *sums).alias("fingerprint"))


def selection_signature(selected: DataFrame, *, row_id: str = "txn_id", coverage: str = "coverage") -> DataFrame:
    """Fingerprint of the selected rows of every coverage."""
    return table_fingerprint(selected, [row_id], by=[coverage])


def changed_selections(before: DataFrame, after: DataFrame, coverage: str = "coverage") -> DataFrame:
    """Coverages whose selection differs between two computations; empty when nothing moved."""
    a = before.select(coverage, F.col("rows").alias("rows_before"), F.col("fingerprint").alias("fingerprint_before"))
    b = after.select(coverage, F.col("rows").alias("rows_after"), F.col("fingerprint").alias("fingerprint_after"))
    both = a.join(b, coverage, "full_outer")
    same = F.col("rows_before").eqNullSafe(F.col("rows_after")) & F.col("fingerprint_before").eqNullSafe(
        F.col("fingerprint_after")
    )
    return both.filter(~same)


def population_manifest(df: DataFrame, *, time: str, label: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows, positives, time range, duplicates and observed labels of a table, as one row."""
    facts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(label).cast("bigint").alias("positive_count"),
        F.avg(F.col(label).cast("double")).alias("positive_rate"),
        F.min(time).alias("time_min"),
        F.max(time).alias("time_max"),
        F.count_if(F.col(label).isNull()).alias("target_missing_count"),
        F.avg(F.col(time).isNotNull().cast("double")).alias("timestamp_parse_coverage"),
        F.concat_ws(",", F.sort_array(F.collect_set(F.col(label).cast("string")))).alias("observed_labels"),
    )
    return with_constants(facts, exact_duplicates(df, columns).select("duplicate_rows"))


def write_table(df: DataFrame, path: str, *, form: str = "parquet", by: Sequence[str] = (), mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    if by:
        writer = writer.partitionBy(*by)
    if form == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(form).save(path)


def json_safe(df: DataFrame) -> DataFrame:
    """Report columns with NaN or infinite values turned into null."""
    return df.withColumns(
        {f.name: finite_or_null(F.col(f.name)) for f in df.schema if f.dataType.simpleString() in ("double", "float")}
    )


SCORE_COLUMNS = ("txn_id", "split", "y", "raw", "calibrated")


def write_scores(scores: DataFrame, path: str, facts: Mapping[str, str]) -> DataFrame:
    """Store scores and labels with a one-row manifest that carries their fingerprint."""
    spark = scores.sparkSession
    write_table(scores.select(*SCORE_COLUMNS), f"{path}/scores")
    stored = spark.read.parquet(f"{path}/scores")
    manifest = table_fingerprint(stored, SCORE_COLUMNS).withColumns({k: F.lit(v) for k, v in facts.items()})
    write_table(manifest, f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Load stored scores; a fingerprint that no longer matches is an error."""
    stored = spark.read.parquet(f"{path}/scores")
    manifest = spark.read.parquet(f"{path}/manifest").first()
    found = table_fingerprint(stored, SCORE_COLUMNS).first()
    if (found["rows"], found["fingerprint"]) != (manifest["rows"], manifest["fingerprint"]):
        raise ValueError(f"{path}: stored scores do not match their manifest")
    return stored


def alignment_mismatches(scores: DataFrame, rows: DataFrame, *, row_id: str = "txn_id", label: str = "label") -> DataFrame:
    """Rows present on one side only, or with different labels."""
    a = scores.select(F.col(row_id).alias("__a"), F.col("y").alias("__ya"))
    b = rows.select(F.col(row_id).alias("__b"), F.col(label).alias("__yb"))
    both = a.join(b, F.col("__a") == F.col("__b"), "full_outer")
    bad = F.col("__a").isNull() | F.col("__b").isNull() | (F.col("__ya").cast("int") != F.col("__yb").cast("int"))
    return both.filter(bad)


def write_outputs(outputs: Mapping[str, DataFrame], path: str) -> DataFrame:
    """Write named tables and a lineage table with one fingerprint per output."""
    spark = next(iter(outputs.values())).sparkSession
    lineage: DataFrame | None = None
    for name, df in outputs.items():
        write_table(df, f"{path}/{name}")
        row = table_fingerprint(spark.read.parquet(f"{path}/{name}")).withColumn("output", F.lit(name))
        lineage = row if lineage is None else lineage.unionByName(row)
    write_table(lineage, f"{path}/_lineage")
    return spark.read.parquet(f"{path}/_lineage")


def changed_outputs(spark: SparkSession, path: str) -> list[str]:
    """Outputs whose content differs from the lineage table."""
    changed = []
    for r in spark.read.parquet(f"{path}/_lineage").collect():
        found = table_fingerprint(spark.read.parquet(f"{path}/{r['output']}")).first()
        if (found["rows"], found["fingerprint"]) != (r["rows"], r["fingerprint"]):
            changed.append(r["output"])
    return sorted(changed)

