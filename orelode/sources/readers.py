"""Sources: repository files, git history, coverage, graph exports, configuration, baselines.

Bulk inputs (files, commit logs, coverage XML, graph JSON) are Spark scans; only what is small by
nature (a configuration file, `git ls-files` of the local repository) is read on the driver.
"""

from __future__ import annotations

import sqlite3
import subprocess
import tomllib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orelode.functions import text as T
from orelode.sources import constants as C
from orelode.sources import schemas

_EXTENSIONS = r"\.(py|rs|md)$"


def listed_files(spark: SparkSession, repo: str, only: str | None = None) -> DataFrame:
    """(rel, content) of tracked and untracked but not ignored files; the walk where there is no git."""
    try:
        names = subprocess.run(["git", "-C", repo, "ls-files", "-co", "--exclude-standard"], capture_output=True, text=True, check=True).stdout.splitlines()
    except (OSError, subprocess.CalledProcessError):
        return walked_files(spark, repo)
    names = sorted({n for n in names if n.endswith((".py", ".rs", ".md")) and not n.startswith("tests/fixtures/") and (only is None or n == only)})
    listed = spark.createDataFrame([(n,) for n in names], "rel string")
    return walked_files(spark, repo, skip=False).join(listed, "rel", "left_semi")


def walked_files(spark: SparkSession, root: str, skip: bool = True) -> DataFrame:
    """All files below root by extension, without skipped directories; unreadable bytes are replaced."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{py,rs,md}").load(root)
    base = root if "://" in root else Path(root).resolve().as_posix()
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*(?=/)", ""), "^" + _quoted(base.rstrip("/")) + "/", "")
    files = raw.select(rel.alias("rel"), F.decode("content", "UTF-8").alias("content"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))
    if skip:
        files = files.filter(~F.arrays_overlap(F.split("rel", "/"), F.array(*map(F.lit, C.SKIP_DIRS))) & ~F.col("rel").rlike(r"(^|/)(\.venv|venv|\.conda)[^/]*/"))
    return files.filter(F.col("rel").rlike(_EXTENSIONS))


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c in "/_-" else "\\" + c for c in text)


def git_commits(spark: SparkSession, repo: str, most: int = 200) -> DataFrame:
    """Rows (commit, ts, file) of the local history, newest commits first, as many as the window can use."""
    log = subprocess.run(["git", "-C", repo, "log", f"-{most}", "--name-only", "--format=%x01%H %ct"], capture_output=True, text=True, check=False).stdout
    rows, commit, ts = [], "", 0
    for line in log.splitlines():
        if line.startswith("\x01"):
            commit, stamp = line[1:].split(" ")
            ts = int(stamp)
        elif line.strip():
            rows.append((commit, ts, line.strip()))
    return spark.createDataFrame(rows, "commit string, epoch bigint, file string").select("commit", F.timestamp_seconds("epoch").alias("ts"), "file")


def file_history(commits: DataFrame, most: int = 200, days: int = 730) -> DataFrame:
    """Change counts and newest touch by file over the last commits of the window.

    Commits are ranked after a distinct and a global limit, so no window holds the whole log.
    """
    recent = commits.select("commit", "ts").distinct().filter(F.col("ts") >= F.current_timestamp() - F.expr(f"interval {days} days")).orderBy(F.desc("ts"), "commit").limit(most).select("commit")
    kept = commits.join(F.broadcast(recent), "commit").filter(F.col("file").rlike(_EXTENSIONS) & ~F.col("file").rlike(r"^\.venv/|(^|/)node_modules/"))
    return kept.groupBy(F.col("file").alias("rel")).agg(F.countDistinct("commit").alias("n"), F.max("ts").alias("last_modified"))


def coverage_xml(spark: SparkSession, path: str) -> DataFrame:
    """(rel, lines) of a Cobertura report; lines without a number are skipped, duplicates collapse to most hits."""
    schema = "_filename string, lines struct<line: array<struct<_number: string, _hits: string>>>"
    classes = spark.read.format("xml").option("rowTag", "class").schema(schema).load(path)
    lines = classes.select(F.col("_filename").alias("rel"), F.explode_outer("lines.line").alias("l")).filter("rel like '%.py'")
    each = lines.groupBy("rel", F.expr("try_cast(l._number as int)").alias("line")).agg(F.max(F.expr("try_cast(l._hits as int)")).alias("hits"))
    return each.groupBy("rel").agg(F.array_sort(F.collect_list(F.when(F.col("hits") > 0, F.col("line")))).alias("lines"))


def numbits(column: str) -> Column:
    """Lines of a packed bitmap (bit b of byte i is line 8 i + b)."""
    bits = F.length(column) * 8 - 1
    byte = lambda i: F.conv(F.hex(F.substr(F.col(column), (F.floor(i / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.when(F.length(column) > 0, F.filter(F.sequence(F.lit(0), bits), lambda i: F.getbit(byte(i), (i % 8).cast("int")) == 1)).otherwise(F.array().cast("array<int>"))


def coverage_sqlite(spark: SparkSession, path: str) -> DataFrame:
    """(rel, lines) of a coverage.py data file of this machine."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        rows = db.execute("select f.path, b.numbits from file f left join line_bits b on b.file_id = f.id").fetchall()
    raw = spark.createDataFrame([(p, bytearray(b or b"")) for p, b in rows], "rel string, bits binary")
    return raw.select("rel", F.explode_outer(numbits("bits")).alias("line")).groupBy("rel").agg(F.array_sort(F.collect_set("line")).alias("lines"))


def load_coverage(spark: SparkSession, repo: str) -> DataFrame | None:
    """Coverage.xml, else .coverage, else nothing; stale if a test is newer than the snapshot."""
    root = Path(repo)
    for name, reader in (("coverage.xml", coverage_xml), (".coverage", coverage_sqlite)):
        if (root / name).exists():
            newest = max((p.stat().st_mtime for p in root.glob("tests/**/*.py")), default=0.0)
            return reader(spark, str(root / name)).withColumn("stale", F.lit(newest > (root / name).stat().st_mtime))
    return None


def graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """Nodes and edges of a graph export; None (with the rules that need it) where the version differs."""
    raw = spark.read.schema(schemas.GRAPH).option("multiLine", "true").json(path)
    version = raw.select("contract_version").first()
    if version is None or version[0] != schemas.GRAPH_VERSION:
        return None
    return raw.select(F.explode("nodes").alias("n")).select("n.*"), raw.select(F.explode("edges").alias("e")).select("e.*")


class Config:
    """Global ignores, (glob, signals) in order, guidance by signal. `group:` names expand to their members."""

    def __init__(self, raw: dict, families: dict[str, list[str]]):
        def expanded(names):
            return [m for n in names for m in (families.get(n[6:], [n[6:]]) if n.startswith("group:") else [n])]

        self.ignores = expanded(raw.get("ignore", []))
        self.globs = [(k, expanded(v.get("ignore", []) if isinstance(v, dict) else v)) for k, v in raw.get("per-glob", {}).items()]
        known = {m for ms in families.values() for m in ms} | set(families)
        self.guidance = {k: v for k, v in raw.get("guidance", {}).items() if k in known}

    @classmethod
    def load(cls, repo: str, families: dict[str, list[str]], tool: str = "quality") -> Config:
        root = Path(repo)
        if (own := root / f".{tool}.toml").exists():
            return cls(tomllib.loads(own.read_text()), families)
        if (shared := root / "pyproject.toml").exists():
            return cls(tomllib.loads(shared.read_text()).get("tool", {}).get(tool, {}), families)
        return cls({}, families)

    def table(self, spark: SparkSession) -> DataFrame:
        """(ord, pattern, signal): a configuration's few rows."""
        rows = [(0, None, s) for s in self.ignores] + [(i, T.glob_regex(g), s) for i, (g, ss) in enumerate(self.globs, 1) for s in ss]
        return spark.createDataFrame(rows, "ord int, pattern string, signal string")


def baseline(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """Current keys `kind:file:line:function`, and how many entries had another shape."""
    raw = spark.read.schema(schemas.BASELINE).option("multiLine", "true").json(path)
    keys = raw.select(F.explode("actions").alias("key")).distinct()
    sound = F.col("key").rlike(r"^[^:]*:[^:]*:\d+:")
    return keys.filter(sound), keys.filter(~sound).count()


def markdown_lines(docs: DataFrame) -> DataFrame:
    """(rel, line, text) outside code fences; parity of fence lines so far, within each document's own array."""
    lines = F.split("content", "\n", -1)
    fence = lambda x: x.rlike(r"^\s*(```|~~~)")
    start = F.struct(F.lit(0).alias("open"), F.expr("cast(array() as array<boolean>)").alias("inside"))
    flags = F.aggregate(lines, start, lambda s, x: F.struct(F.when(fence(x), 1 - s["open"]).otherwise(s["open"]).alias("open"), F.concat(s["inside"], F.array((s["open"] == 1) | fence(x))).alias("inside")), lambda s: s["inside"])
    rows = docs.select("rel", F.posexplode(F.arrays_zip(lines.alias("text"), flags.alias("inside"))).alias("pos", "l"))
    return rows.filter("not l.inside").select("rel", (F.col("pos") + 1).alias("line"), F.col("l.text").alias("text"))


def markdown_refs(docs: DataFrame) -> DataFrame:
    """(rel, line, target, ticked): link targets without anchors, and backticked .md paths; schemes are skipped."""
    lines = markdown_lines(docs)
    links = lines.select("rel", "line", F.explode(F.regexp_extract_all("text", F.lit(r"\]\(\s*<?([^)\s>]+)"), F.lit(1))).alias("target"), F.lit(False).alias("ticked"))
    ticks = lines.select("rel", "line", F.explode(F.regexp_extract_all("text", F.lit(r"`([^`\s]+\.md)`"), F.lit(1))).alias("target"), F.lit(True).alias("ticked"))
    plain = links.unionByName(ticks).withColumn("target", F.regexp_replace("target", "#.*$", "")).filter("target <> ''")
    scheme = "|".join("^" + _quoted(s) for s in C.LINK_SCHEMES)
    return plain.filter(~F.col("target").rlike(scheme))


def resolved(base: str, target: str) -> Column:
    """A link target from its document's folder, with . and .. taken out by one fold over its parts."""
    joined = F.when(F.col(target).startswith("/"), F.col(target)).otherwise(F.concat_ws("/", F.regexp_extract(base, "^(.*)/", 1), target))
    parts = F.filter(F.split(joined, "/"), lambda p: ~p.isin("", "."))
    stack = F.aggregate(parts, F.expr("cast(array() as array<string>)"), lambda s, p: F.when(p == "..", F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.concat(s, F.array(p))))
    return F.array_join(stack, "/")


def newest_first(df: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
