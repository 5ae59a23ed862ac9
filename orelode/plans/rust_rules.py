"""Rules over Rust facts: what items and tokens tell."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelode.operators import graphs
from orelode.plans.rules import has, msg, out
from orelode.sources import constants as C


def _prod(facts: DataFrame, kind: str) -> DataFrame:
    return facts.filter((F.col("kind") == kind) & ~has("test") & ~F.col("rel").rlike("(^|/)tests/"))


def _graph(facts: DataFrame) -> DataFrame:
    """File edges from `mod` declarations and `use crate::` paths (the longest prefix that is a file)."""
    files = facts.filter("kind = 'module'").select("rel", F.regexp_replace(F.regexp_replace(F.regexp_replace("rel", r"^(.*/)?src/", ""), r"(/mod)?\.rs$", ""), "^(main|lib)$", "").alias("path"))
    uses = facts.filter("kind = 'use' and name like 'crate::%'").select(F.col("rel").alias("src"), F.array_remove(F.split(F.regexp_replace("name", r"[{].*$", ""), "::"), "").alias("p"))
    prefixes = uses.select("src", F.posexplode(F.transform(F.sequence(F.lit(2), F.size("p")), lambda n: F.array_join(F.slice("p", 2, n - 1), "/"))).alias("n", "path"))
    found = prefixes.join(files, "path").groupBy("src", F.substring_index("path", "/", 1).alias("head")).agg(F.max_by("rel", "n").alias("dst"))
    return found.select("src", "dst").distinct()


def findings(facts: DataFrame, signals: list[str] | None = None) -> DataFrame:
    functions, calls = _prod(facts, "function"), _prod(facts, "call")
    groups = functions.filter("owner = '' and a >= 1").withColumn("type", F.regexp_replace(F.regexp_extract(F.get("items", F.lit(0)), ":&?(?:mut)?([A-Z]\\w*)", 1), "^$", ""))
    own = _prod(facts, "class").select("rel", F.col("name").alias("type"))
    modules = _prod(facts, "module").withColumn("n", F.col("a") + F.col("b")).withColumn("owner", F.lit(""))
    tests = facts.filter((F.col("kind") == "function") & has("test"))
    rings = graphs.cycles(_graph(facts)).groupBy("label").agg(F.array_join(F.array_sort(F.collect_list("node")), " -> ").alias("ring"))
    every = {
        "complexity": ("fail", "complexity", out(functions.filter("b >= 15"), msg("complexity %d", "b"), function="name")),
        "long-param-list": ("fail", "long-param-list", out(functions.filter((F.col("a") > 5) & ~has("stub")), msg("%d parameters", "a"), function="name")),
        "large-function": ("fail", "large-function", out(functions.filter("end - line + 1 >= 120"), "a function of 120 lines and more", function="name")),
        "several-definitions": ("warn", "several-definitions", out(modules.filter("n between 3 and 10"), msg("%d definitions in a module", "n"), F.lit(1))),
        "many-definitions": ("warn", "many-definitions", out(modules.filter("n >= 11"), msg("%d definitions in a module", "n"), F.lit(1))),
        "mixed-module": ("warn", "mixed-module", out(modules.filter("n >= 20 and b >= 6"), msg("%d items in many parts", "n"), F.lit(1))),
        "strewing": ("fail", "latent-class", out(groups.join(own, ["rel", "type"], "left_semi").groupBy("rel", "type").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("line")).filter("n >= 3"), msg("%d functions take %s first", "n", "type"), function="type")),
        "closures": ("fail", "latent-class", out(functions.filter("c >= 2 and (b >= 15 or end - line + 1 >= 60)"), msg("%d closures", "c"), function="name")),
        "detached-method": ("warn", "detached-method", out(functions.filter(has("method") & ~has("uses_receiver") & ~has("stub")), "never uses its receiver", function="name")),
        "vague-name": ("fail", "vague-name", out(_prod(facts, "class").filter(F.col("name").rlike(f"({'|'.join(C.VAGUE_SUFFIXES)})$")).join(functions.filter("owner <> ''").groupBy("rel", F.col("owner").alias("name")).agg(F.count(F.lit(1)).alias("n")).filter("n >= 6"), ["rel", "name"]), "a role instead of a noun", function="name")),
        "debug-artifact": ("fail", "debug-artifact", out(calls.filter(has("panics")), msg("%s in production", "name"))),
        "swallow": ("fail", "swallow", out(_prod(facts, "handler"), "a result is thrown away")),
        "allow-reason": ("fail", "allow-reason", out(facts.filter("kind = 'bare_ignore' and name = 'allow-reason'"), msg("%s without a reason", "text"))),
        "skipif": ("fail", "skipif", out(facts.filter("kind = 'decorator' and name = 'ignore'"), "an ignored test")),
        "no-assert-test": ("fail", "no-assert-test", out(tests.filter(~has("assertion") & F.col("name").rlike("test|_is_|_are_")), "asserts nothing", function="name")),
        "suppression": ("fail", "suppression", out(facts.filter("kind = 'marker' and text = ''").withColumn("owner", F.lit("")), msg("%s is silenced without a reason", "name"))),
        "import-cycle": ("fail", "import-cycle", out(rings.select(F.col("label").alias("rel"), F.lit("").alias("owner"), "ring"), msg("%s", "ring"), F.lit(1))),
    }
    parts = [df.select("rel", "line", "function", F.lit(signal).alias("signal"), F.lit(kind).alias("kind"), F.coalesce("own_severity", F.lit(severity)).alias("severity"), "message") for signal, (severity, kind, df) in every.items() if signals is None or signal in signals]
    return reduce(DataFrame.unionByName, parts) if parts else out(facts.limit(0), "").select("rel", "line", "function", F.lit("").alias("signal"), F.lit("").alias("kind"), F.lit("").alias("severity"), "message")
