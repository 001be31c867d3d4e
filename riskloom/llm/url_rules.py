"""URL allow and block rules by host-suffix and path-prefix expressions.

Every URL is expanded into (host suffix, path prefix) expressions.  They meet
the rules in an equi-join on a short prefix of the expression's digest; the
full digest and the rest of the rule's path confirm the hit, and the longest
confirmed rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.text import ascii_lower

#: Rules up to this many are broadcast; more meet the expressions in a shuffled join.
BROADCAST_RULES = 100_000
#: Hex digits of the short hash.
PREFIX_DIGITS = 8


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): both empty for a null URL or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _digest(host: Column, base: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), base), 256)


def _base(path: Column) -> Column:
    """A rule's path up to its last slash."""
    return F.regexp_extract(path, r"(?s)^(.*/)", 1)


def _slashes(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def prepared_rules(rules: DataFrame) -> DataFrame:
    """One row per (host, path): the rule with its digest.  Of equal rules with both verdicts, block stands."""
    return (
        rules.where(F.col("rule_host").isNotNull() & F.col("rule_path").isNotNull() & (F.col("rule_host") != ""))
        .groupBy(ascii_lower(F.col("rule_host")).alias("rule_host"), "rule_path")
        .agg(F.max("verdict").alias("rule_verdict"))
        .select(
            "rule_host",
            "rule_path",
            "rule_verdict",
            _digest(F.col("rule_host"), _base(F.col("rule_path"))).alias("rule_digest"),
            F.size(F.split("rule_host", r"\.")).alias("labels"),
            _slashes(_base(F.col("rule_path"))).alias("depth"),
        )
        .withColumn("short", F.substring("rule_digest", 1, PREFIX_DIGITS))
    )


def judge_urls(pages: DataFrame, rules: DataFrame, *, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict; every input row comes back once.

    ``rules`` has rule_host, rule_path and verdict ('allow' or 'block').  A rule
    fits its host and all subdomains when the URL's path starts with the rule's
    path; the longest rule wins.  A URL without a fitting rule, a null URL and
    an empty one get a null rule and the ``default`` verdict.  A column of
    ``pages`` named like a result column is replaced.

    Only suffixes and prefixes as long as some rule's are made, so a hostile
    URL with thousands of dots or slashes stays cheap and no hit is lost.
    """
    known = prepared_rules(rules)
    most = known.agg(F.max("labels").alias("labels"), F.max("depth").alias("depth"), F.count("*").alias("n")).first()
    host, path = url_parts(F.col(url))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    parted = pages.select(*kept, host.alias("host"), path.alias("path"))
    if not most["n"]:
        return parted.select(*kept, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    names = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(names), F.lit(most["labels"]))),
        lambda k: F.array_join(F.slice(names, -k, k), "."),
    )
    bases = F.transform(
        F.sequence(F.lit(0), F.least(_slashes(F.col("path")), F.lit(most["depth"]))),
        lambda k: F.when(k > 0, F.concat(F.call_function("substring_index", F.col("path"), F.lit("/"), k), F.lit("/"))).otherwise(F.lit("")),
    )
    expressions = (
        parted.where(F.col("host") != "")
        .select("host", "path", F.explode(suffixes).alias("suffix"), bases.alias("bases"))
        .select("host", "path", "suffix", F.explode("bases").alias("base"))
        .withColumn("digest", _digest(F.col("suffix"), F.col("base")))
        .withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))
    )
    side = F.broadcast(known) if most["n"] <= BROADCAST_RULES else known
    best = (
        expressions.join(side, "short")
        .where((F.col("digest") == F.col("rule_digest")) & (F.col("suffix") == F.col("rule_host")) & F.col("path").startswith(F.col("rule_path")))
        .groupBy("host", "path")
        .agg(
            F.max(
                F.struct(
                    (F.length("rule_host") + F.length("rule_path")).alias("size"),
                    F.concat("rule_host", "rule_path").alias("rule"),
                    F.col("rule_verdict").alias("verdict"),
                )
            ).alias("best")
        )
    )
    return parted.join(best, ["host", "path"], "left").select(
        *kept, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
