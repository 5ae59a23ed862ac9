"""URL filters with DataFrame functions only: host and path rules by a sorted sweep.

A host's key is its labels in reverse with a dot after each, so the hosts under a rule's host are the
interval of keys that start with the rule's. Intervals nest or are apart. The sweep goes over keys in
order: at a rule host's interval start its rules join the stack of active rules, at its end they leave
it; every url takes the stack that is active at its key, and of its rules the longest whose path the
url's path starts with.

The sweep is dealt by ranges of (key, a spread of the urls' paths), so a host with a third of all urls
spans many tasks; the stack at each range's start is carried in from the ranges before it (one row per
range, which the window over the ranges' last stacks gives).

Defined results: a null url or one without `://` has an empty host and path, which no rule fits. Rules
with the same host and path: `block` wins over `allow`. Rules with a null or empty host fit nothing.
Repeated rows and extra columns stay as they are;
columns named host, path, rule or verdict are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orelode.llm.common import Scratch, ascii_lower, workers


STACK = "array<struct<length: int, path: string, rule: string, verdict: string>>"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    # up to the first of / ? #
    host = F.substring_index(F.substring_index(F.substring_index(rest, "/", 1), "?", 1), "#", 1)
    path = F.substring_index(F.substring_index(F.substr(rest, F.length(host) + 1), "?", 1), "#", 1)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def host_key(host: Column) -> Column:
    """a.example.net -> net.example.a. (dots after each label: a rule's key is a prefix just of itself and its subdomains)."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) rows; a list that comes with the program, so of known size."""
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def stacks(rules: DataFrame) -> DataFrame:
    """Where the stack of active rules changes: key and the stack from there on (rules of the key's host and of the hosts above).

    A host's stack is found by its own ancestors (an equi-join on host), never by comparing all rules with each other.
    """
    clean = rules.select(F.lower("host").alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").filter("host <> ''").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    by_host = clean.groupBy("host").agg(F.collect_list(F.struct((F.length("host") + F.length("path")).alias("length"), "path", F.concat("host", "path").alias("rule"), "verdict")).alias("own"))
    labels = F.split("host", r"\.", -1)
    above = by_host.select("host", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("up", "ancestor"))
    joined = above.join(by_host.select(F.col("host").alias("ancestor"), "own"), "ancestor")
    both = joined.groupBy("host").agg(F.flatten(F.collect_list("own")).alias("inside"), F.flatten(F.collect_list(F.when(F.col("up") > 0, F.col("own")))).alias("outside"))
    key = host_key(F.col("host"))
    # '/' is the character after '.': the first key beyond all that start with `key`
    end = F.concat(F.substr(key, F.lit(1), F.length(key) - 1), F.lit("/"))
    edges = both.select(F.explode(F.array(F.struct(key.alias("key"), F.col("inside").alias("stack")), F.struct(end.alias("key"), F.col("outside").alias("stack")))).alias("e")).select("e.*")
    return edges.select("key", "stack")  # starts end in '.', ends in '/', and each host has one of both: no key twice


def url_rules(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule (host + path, null if none fits) and verdict (the rule's, else default)."""
    spark = pages.sparkSession
    names = pages.columns
    host, path = host_and_path(F.col(url_col).cast("string"))
    rows = pages.select(F.struct("*").alias("row"), host.alias("host"), path.alias("path"))
    # equal urls differ in spread, so that ranges can part them
    rows = rows.select("row", "host", "path", host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), F.xxhash64("path", F.monotonically_increasing_id()).alias("spread"))
    edges = stacks(rules).select("key", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("spread"), "stack")
    both = rows.unionByName(edges, allowMissingColumns=True).repartitionByRange(workers(spark), "key", "kind", "spread")
    dealt = Scratch(spark, "urls").keep(both.withColumn("range", F.spark_partition_id()), "ranges")
    left = dealt.groupBy("range").agg(F.max_by("stack", F.when(F.col("kind") == 0, F.col("key"))).alias("stack"))  # a row per range
    carried = left.select("range", F.last("stack", ignorenulls=True).over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    order = Window.partitionBy("range").orderBy("key", "kind", "spread")
    swept = dealt.withColumn("stack", F.last("stack", ignorenulls=True).over(order)).filter("kind = 1").join(carried, "range", "left")
    active = F.coalesce("stack", "carried", F.array().cast(STACK))
    fits = F.filter(active, lambda r: F.startswith(F.col("path"), r["path"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(r["length"].alias("length"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    judged = swept.select("row", "host", "path", best.alias("best"))
    return judged.select(*[F.col(f"row.`{c}`").alias(c) for c in names if c not in ("host", "path", "rule", "verdict")], "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
