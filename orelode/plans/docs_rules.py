"""Rules over Markdown documents: dead links, and documents that nothing leads to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelode.operators import graphs
from orelode.sources.readers import markdown_refs, resolved


def docs_links(docs: DataFrame, files: DataFrame, ignored: DataFrame | None = None) -> DataFrame:
    """Links of docs/**, README and AGENTS whose target is neither a file, a folder of one, nor ignored. Bare backticks are no links."""
    refs = markdown_refs(docs).filter("not ticked and rel rlike '^docs/|(^|/)(README|AGENTS)\\\\.md$'").withColumn("target", resolved("rel", "target"))
    folders = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("rel", "/"))), lambda i: F.array_join(F.slice(F.split("rel", "/"), 1, i), "/"))).alias("target")).distinct()
    dead = refs.join(folders, "target", "left_anti")
    if ignored is not None:
        dead = dead.join(ignored.select(F.col("rel").alias("target")), "target", "left_anti")
    return dead.select("rel", "line", "target")


def undiscoverable(docs: DataFrame, root: str = "AGENTS.md") -> DataFrame:
    """Documents that no chain of references from the root document reaches."""
    edges = markdown_refs(docs).select(F.col("rel").alias("src"), F.explode(F.array(resolved("rel", "target"), F.col("target"))).alias("dst")).distinct()
    edges = edges.join(docs.select(F.col("rel").alias("dst")), "dst", "left_semi")
    found = graphs.reachable(edges, docs.filter(F.col("rel") == root).select(F.col("rel").alias("node")))
    return docs.select("rel").filter(F.col("rel").startswith("docs/")).join(found.select(F.col("node").alias("rel")), "rel", "left_anti")
