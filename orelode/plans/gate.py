"""From findings to a verdict: suppression, configuration, ranking, baseline, report."""

from __future__ import annotations

import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelode.functions import text as T
from orelode.operators import ranking
from orelode.sources import constants as C
from orelode.sources.readers import Config

# -- suppression (J13, W6, A26, R64, U7) -------------------------------------------


def expanded_markers(markers: DataFrame, families: dict[str, list[str]]) -> DataFrame:
    """(rel, line, signal, scope, marked): one row per signal that a marker stands for; marked is its own word."""
    spark = markers.sparkSession
    pairs = [(f, m) for f, ms in families.items() for m in ms if m != f]
    table = spark.createDataFrame(pairs or [("", "")], "marked string, member string")
    named = markers.filter("why <> ''").select("rel", "line", F.col("signal").alias("marked"), "scope")
    variants = named.join(F.broadcast(table), "marked").select("rel", "line", "marked", "scope", F.col("member").alias("signal"))
    return named.withColumn("signal", F.col("marked")).unionByName(variants)


def suppress(findings: DataFrame, markers: DataFrame, logical: DataFrame, families: dict[str, list[str]]) -> tuple[DataFrame, DataFrame]:
    """(findings that stay, used markers). A line marker silences one site: the nearest of the finding's line, the line before, and
    the same for the statement's first line; a file marker silences all sites of its signal.

    Window lines are exploded, so the join is an equi-join. Sites and markers of one (rel, signal) are then matched
    one to one in a grouped function: lines descending take the nearest unspent marker.
    """
    told = expanded_markers(markers, families)
    whole = told.filter("scope = 'file'").select("rel", "signal", "marked").distinct()
    kept = findings.join(whole.select("rel", "signal").distinct(), ["rel", "signal"], "left_anti")
    starts = logical.select("rel", "line", F.col("start").alias("logical"))
    sites = kept.join(starts, ["rel", "line"], "left").withColumn("logical", F.coalesce("logical", "line")).withColumn("site", F.xxhash64("rel", "line", "function", "signal", "message"))
    window = sites.select("rel", "signal", "site", F.col("line").alias("at"), F.explode(F.array_distinct(F.array(F.col("line"), F.col("line") - 1, F.col("logical"), F.col("logical") - 1))).alias("line")).distinct()
    offers = window.join(told.filter("scope = 'line'").select("rel", "line", "signal", "marked"), ["rel", "line", "signal"])

    def peel(group: pd.DataFrame) -> pd.DataFrame:
        spent, taken = set(), []
        for (at, site), own in sorted(group.groupby(["at", "site"]), key=lambda x: (-x[0][0], x[0][1])):
            for line, marked in sorted(zip(own["line"], own["marked"], strict=True), key=lambda x: (abs(at - x[0]), x)):
                if (line, marked) not in spent:
                    spent.add((line, marked))
                    taken.append((own["rel"].iloc[0], site, line, marked))
                    break
        return pd.DataFrame(taken, columns=["rel", "site", "line", "marked"])

    taken = offers.groupBy("rel", "signal").applyInPandas(peel, "rel string, site long, line int, marked string")
    left = sites.join(taken.select("rel", "site").distinct(), ["rel", "site"], "left_anti").select(*findings.columns)
    used_files = findings.join(whole, ["rel", "signal"]).select("rel", F.lit(0).alias("line"), "marked").distinct()
    return left, taken.select("rel", "line", "marked").distinct().unionByName(used_files)


def stale_markers(findings: DataFrame, markers: DataFrame, used: DataFrame, families: dict[str, list[str]]) -> DataFrame:
    """Explained markers that nothing used and whose signal fires nowhere in the file."""
    told = expanded_markers(markers, families)
    fired = told.join(findings.select("rel", "signal").distinct(), ["rel", "signal"], "left_semi").select("rel", "marked", "scope", "line")
    own = markers.filter("why <> ''").select("rel", "line", F.col("signal").alias("marked"), "scope").distinct()
    idle = own.join(fired.distinct(), ["rel", "marked", "scope", "line"], "left_anti").join(used, ["rel", "line", "marked"], "left_anti")
    return idle.select("rel", "line", F.lit("").alias("function"), F.lit("stale-suppression").alias("signal"), F.lit("stale-suppression").alias("kind"), F.lit("fail").alias("severity"), F.format_string("nothing fires for %s here", "marked").alias("message"))


# -- actions (P5, P7 to P12, A17, A18, W1, T4) -----------------------------------------


def apply_config(findings: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """(findings that stay with guidance, ignored counts). The first glob that matches a path decides."""
    spark = findings.sparkSession
    globs = sorted({(i, T.glob_regex(g)) for i, (g, _) in enumerate(config.globs, 1)})
    first = F.coalesce(*[F.when(F.col("rel").rlike(p), F.lit(i)) for i, p in globs], F.lit(0)) if globs else F.lit(0)
    tagged = findings.withColumn("ord", first)
    table = config.table(spark).select("ord", "signal").distinct()
    everywhere = F.broadcast(table.filter("ord = 0").select("signal"))
    placed = F.broadcast(table.filter("ord > 0"))
    marked = tagged.join(everywhere.withColumn("g", F.lit(True)), "signal", "left").join(placed.withColumn("p", F.lit(True)), ["ord", "signal"], "left").withColumn("out", F.coalesce("g", "p", F.lit(False)))
    counts = marked.filter("out").groupBy("signal").agg(F.count(F.lit(1)).alias("n"))
    kept = marked.filter("not out").select(*findings.columns)
    if config.guidance:
        advice = F.broadcast(spark.createDataFrame(list(config.guidance.items()), "signal string, advice string"))
        kept = kept.join(advice, "signal", "left").withColumn("message", F.concat("message", F.coalesce(F.concat(F.lit(" — house rule: "), "advice"), F.lit("")))).select(*findings.columns)
    return kept, counts


def actions(findings: DataFrame, churn: DataFrame | None = None, include_tests: bool = False) -> DataFrame:
    """Findings with churn and a raw score; of test files only the rules that live in tests."""
    kept = findings if include_tests else findings.filter(~T.is_test_gate(F.col("rel")) | F.col("signal").isin(*C.TEST_ONLY_SIGNALS))
    with_churn = kept.join(churn.select("rel", F.col("n").alias("churn")), "rel", "left") if churn is not None else kept.withColumn("churn", F.lit(None).cast("long"))
    metric = F.coalesce(F.expr("try_cast(regexp_extract(message, '([0-9]+)', 1) as double)"), F.lit(1.0))
    scale = F.when(F.col("signal").isin("complexity"), metric / 40).when(F.col("signal") == "large-function", F.lit(0.5)).when(F.col("severity") == "warn", F.lit(0.25)).otherwise(F.lit(0.4))
    n = F.coalesce("churn", F.lit(0))
    return with_churn.withColumn("churn", n).withColumn("raw", F.least(scale, F.lit(1.0)) * T.churn_factor(n)).withColumn("key", F.concat_ws(":", "kind", "rel", "line", "function"))


def dedupe_and_rank(acts: DataFrame) -> DataFrame:
    """One action a key, of largest score; priority 1 to 99."""
    best = ranking.keep_best(acts.withColumn("ord", F.abs(F.hash("message"))), ["kind", "rel", "line", "function"], "raw", "ord").drop("ord")
    return ranking.minmax_rank(best, "raw")


def merge_targets(acts: DataFrame) -> DataFrame:
    """The actions of one target together."""
    notes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "message"))), lambda x: x["message"]), "; ")
    return acts.groupBy("rel", "function").agg(
        F.max("raw").alias("raw"), F.max("priority").alias("priority"), F.min("line").alias("line"), F.max(F.when(F.col("severity") == "fail", 1).otherwise(0)).alias("fails"),
        F.array_sort(F.collect_set("kind")).alias("kinds"), notes.alias("notes"), F.count(F.lit(1)).alias("n"),
    )


# -- baseline and verdict (J14, K4, K7, A15) -----------------------------------------------


def against_baseline(acts: DataFrame, baseline: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """(actions with ack, stale keys): known keys are acknowledged, keys of nothing are stale."""
    if baseline is None:
        return acts.withColumn("ack", F.lit(False)), None
    known = baseline.select("key").distinct()
    told = acts.join(known.withColumn("_known", F.lit(True)), "key", "left").withColumn("ack", F.coalesce("_known", F.lit(False))).drop("_known")
    return told, known.join(acts.select("key"), "key", "left_anti")


def write_baseline(acts: DataFrame, path: str, ignored: DataFrame | None = None) -> None:
    """K4: the keys of failing actions and the ignored counts, as one JSON document (a baseline is read as a whole)."""
    keys = acts.filter("severity <> 'warn'").agg(F.array_sort(F.collect_set("key")).alias("actions"))
    counts = ignored.agg(F.map_from_entries(F.collect_list(F.struct("signal", "n"))).alias("config_ignored")) if ignored is not None else keys.select(F.expr("cast(map() as map<string, bigint>)").alias("config_ignored"))
    keys.crossJoin(counts).coalesce(1).write.mode("overwrite").json(path)


@dataclass
class Verdict:
    fails: int
    warns: int
    ack: int
    stale: int
    targets: int
    warn_only: bool = False

    @property
    def exit_code(self) -> int:
        return int(not self.warn_only and bool(self.fails or self.stale))


def verdict(acts: DataFrame, stale: DataFrame | None, warn_only: bool = False) -> Verdict:
    """One aggregation."""
    failing = ~F.col("ack") & (F.col("severity") == "fail")
    row = acts.agg(F.count_if(failing), F.count_if(~F.col("ack") & (F.col("severity") == "warn")), F.count_if("ack"), F.countDistinct(F.when(failing, F.struct("rel", "function")))).first()
    return Verdict(row[0], row[1], row[2], stale.count() if stale is not None else 0, row[3], warn_only)


# -- reports (K1 to K3, A14, T5, P15, P16) ----------------------------------------------------


def facts_line(acts: DataFrame) -> DataFrame:
    """What history says of a target, as a column `note`."""
    metric = F.expr("try_cast(regexp_extract(message, '([0-9]+)', 1) as int)")
    parts = F.array_compact(F.array(F.when((F.col("signal") == "complexity") & (metric >= 15), F.format_string("is complex (%d)", metric)), F.when(F.col("churn") >= 10, F.format_string("changes often (%d)", "churn")), F.when(F.col("rel").rlike("^(scripts|tools)/") & (F.col("churn") <= 2), F.lit("is a script that hardly changes"))))
    return acts.withColumn("note", F.array_join(parts, " and "))


def rollup(acts: DataFrame) -> DataFrame:
    """Counts by kind, most first."""
    return acts.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity") == "fail").alias("fails")).orderBy(F.desc("n"), "kind")


def report_rows(acts: DataFrame) -> DataFrame:
    """T4, T5: actions by their file's best priority, then by score, for a text report."""
    worst = acts.groupBy("rel").agg(F.max("priority").alias("file_priority"))
    return acts.join(worst, "rel").orderBy(F.desc("file_priority"), "rel", F.desc("raw"), "line")


def render_text(acts: DataFrame, result: Verdict, most: int = 1000) -> str:
    """K3: a report for people; at most `most` actions are printed, and the rest is counted."""
    lines = [f"GATE: {'FAIL' if result.exit_code else 'PASS'}", f"fails {result.fails}, warns {result.warns}, acknowledged {result.ack}, stale {result.stale}, targets {result.targets}", ""]
    lines += [f"{r['kind']}: {r['n']}" for r in rollup(acts).collect()]
    current, n = None, 0
    for r in report_rows(acts).limit(most).toLocalIterator():
        if r["rel"] != current:
            current = r["rel"]
            lines += ["", current]
        lines.append(f"  {r['line']}: [{r['severity']}] {r['kind']} {r['function']} ({r['priority']}) {r['message']}")
        n += 1
    return "\n".join(lines)


def report_json(acts: DataFrame, result: Verdict, path: str) -> None:
    """K1, K2: one JSON row per action, and a header file beside them."""
    acts.write.mode("overwrite").json(f"{path}/actions")
    header = acts.sparkSession.createDataFrame([(json.dumps(result.__dict__ | {"schema_version": 4}),)], "value string")
    header.coalesce(1).write.mode("overwrite").text(f"{path}/header")


def seam_clusters(acts: DataFrame, least: int = 3) -> DataFrame:
    """Actions that share a target or a member word of their message, in clusters of `least` and more."""
    from orelode.operators import graphs

    members = acts.select("key", F.explode(F.array_union(F.array(F.concat_ws(":", "rel", "function")), F.transform(F.regexp_extract_all("message", F.lit(r"([a-z_]{6,})"), F.lit(1)), lambda w: F.concat_ws("#", "rel", w)))).alias("m"))
    edges = members.select(F.concat(F.lit("k:"), "key").alias("src"), F.concat(F.lit("m:"), "m").alias("dst"))
    labels = graphs.components(edges).filter("node like 'k:%'")
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return labels.join(sizes, "label").select("label", F.substring("node", 3, 1 << 20).alias("key"), "n")
