"""Transaction-alert auditing on Spark.

The package turns a transaction table into strictly-past history features,
time-safe splits, fitted fuzzy rules, ranking and calibration metrics, audited
rule evidence, budgeted alert selection, and the controls that check it.
"""

__version__ = "0.1.0"
