"""Engine.scan: repository files to ranked actions and a verdict, in one lazy plan."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.operators.tables import settle
from orelode.plans import docs_rules, gate, rules, rust_rules
from orelode.sources import readers
from orelode.sources.python_facts import python_facts
from orelode.sources.rust_facts import rust_facts


def families() -> dict[str, list[str]]:
    out: dict[str, list[str]] = defaultdict(list)
    for signal, (_, family, _) in rules.RULES.items():
        out[family].append(signal)
    return dict(out)


class Engine:
    """One repository (or any table of rel and content). Facts are parsed once and settled; all rules read them."""

    def __init__(self, spark: SparkSession, files: DataFrame, churn: DataFrame | None = None, coverage: DataFrame | None = None, graph: tuple[DataFrame, DataFrame] | None = None, config: readers.Config | None = None):
        self.spark, self.churn = spark, churn
        self.files = files.select("rel", "content")
        self.docs = self.files.filter("rel like '%.md'")
        self.python = settle(python_facts(self.files.filter("rel like '%.py'").repartition("rel")))
        self.rust = settle(rust_facts(self.files.filter("rel like '%.rs'").repartition("rel")))
        self.config = config or readers.Config({}, families())
        nodes, edges = graph or (None, None)
        self.tables = rules.Tables(self.python, self.docs, churn, coverage, nodes, edges)

    @classmethod
    def of_repository(cls, spark: SparkSession, repo: str) -> Engine:
        history = readers.file_history(readers.git_commits(spark, repo))
        return cls(spark, readers.listed_files(spark, repo), history, readers.load_coverage(spark, repo), config=readers.Config.load(repo, families()))

    def markers(self) -> DataFrame:
        both = self.python.filter("kind = 'marker'").unionByName(self.rust.filter("kind = 'marker'"))
        return both.select("rel", "line", F.col("name").alias("signal"), F.col("text").alias("why"), F.col("owner").alias("scope"))

    def findings(self, signals: list[str] | None = None) -> DataFrame:
        found = rules.findings(self.tables, signals).unionByName(rust_rules.findings(self.rust, signals))
        if signals is None or "docs-link" in signals:
            dead = docs_rules.docs_links(self.docs, self.files)
            found = found.unionByName(dead.select("rel", F.col("line").cast("int").alias("line"), F.lit("").alias("function"), F.lit("docs-link").alias("signal"), F.lit("docs-link").alias("kind"), F.lit("fail").alias("severity"), F.format_string("%s is not there", "target").alias("message")))
        if signals is None or "docs-undiscoverable" in signals:
            lost = docs_rules.undiscoverable(self.docs)
            found = found.unionByName(lost.select("rel", F.lit(1).alias("line"), F.lit("").alias("function"), F.lit("docs-undiscoverable").alias("signal"), F.lit("docs-undiscoverable").alias("kind"), F.lit("fail").alias("severity"), F.lit("no document leads here").alias("message")))
        return found

    def reconciled(self, signals: list[str] | None = None) -> DataFrame:
        """Findings after suppression, with stale markers."""
        raw = settle(self.findings(signals))
        logical = self.python.filter("kind = 'logical_line'").select("rel", "line", F.col("a").alias("start"))
        left, used = gate.suppress(raw, self.markers(), logical, families())
        return left.unionByName(gate.stale_markers(raw, self.markers(), used, families()))

    def actions(self, signals: list[str] | None = None, include_tests: bool = False) -> DataFrame:
        kept, self.ignored = gate.apply_config(self.reconciled(signals), self.config)
        return gate.dedupe_and_rank(settle(gate.actions(kept, self.churn, include_tests)))

    def run(self, baseline: DataFrame | None = None, warn_only: bool = False) -> tuple[DataFrame, gate.Verdict]:
        acts, stale = gate.against_baseline(settle(self.actions()), baseline)
        return acts, gate.verdict(acts, stale, warn_only)
