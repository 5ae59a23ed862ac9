"""More relational kernels: drift gates, ordered state, texts of findings, streams, and the engine on its own source."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orelode.operators import graphs, ranking
from orelode.operators.tables import settle, shared_folder
from orelode.plans.kernels import ORACLES as _ORACLES
from orelode.plans.kernels import QUERIES as _QUERIES
from orelode.plans.kernels import flow, read
from orelode.sources import readers
from orelode.streaming import buffers

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""
SELECT user_id, event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS start_id FROM events""")
def logical_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last start carried forward over the lines of a file."""
    events = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return ranking.nearest_before(events, "user_id", "event_id", F.col("event_type") == "purchase", "event_id", "start_id").drop("event_type")


@query("""
WITH a AS (SELECT p_brand AS kind, max(p_size) AS severity FROM part WHERE p_partkey % 2 = 0 GROUP BY 1), b AS (SELECT p_brand AS kind, max(p_size) AS severity FROM part WHERE p_partkey % 2 = 1 AND p_size > 5 GROUP BY 1)
SELECT coalesce(a.kind, b.kind) AS kind, CASE WHEN b.kind IS NULL THEN 'unregistered' WHEN a.kind IS NULL THEN 'not emitted' ELSE 'severity differs' END AS drift FROM a FULL JOIN b ON a.kind = b.kind WHERE a.kind IS NULL OR b.kind IS NULL OR a.severity <> b.severity""")
def drift_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emitted against registered kinds, both ways, and differing severities; one grouping tells all three."""
    parts = read(spark, sf_dir, "part").select(F.col("p_brand").alias("kind"), "p_partkey", "p_size")
    emitted, registered = F.col("p_partkey") % 2 == 0, (F.col("p_partkey") % 2 == 1) & (F.col("p_size") > 5)
    both = parts.groupBy("kind").agg(F.max(F.when(emitted, F.col("p_size"))).alias("a"), F.max(F.when(registered, F.col("p_size"))).alias("b")).filter("a is not null or b is not null")
    drift = F.when(F.col("b").isNull(), "unregistered").when(F.col("a").isNull(), "not emitted").when(F.col("a") != F.col("b"), "severity differs")
    return both.select("kind", drift.alias("drift")).filter("drift is not null")


@query("""
WITH c AS (SELECT l_orderkey AS rel, count(*) AS n, min(l_linenumber) AS line FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY 1)
SELECT * FROM c WHERE n >= 2""")
def scattered_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of known classes, two and more in a file."""
    known = read(spark, sf_dir, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"))
    calls = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber").join(known, "l_suppkey", "left_semi")
    return calls.groupBy(F.col("l_orderkey").alias("rel")).agg(F.count(F.lit(1)).alias("n"), F.min("l_linenumber").alias("line")).filter("n >= 2")


@query("""
WITH r AS (SELECT o_custkey AS rel, o_orderkey, o_totalprice, max(o_totalprice) OVER (PARTITION BY o_custkey) AS file_priority FROM orders)
SELECT rel, o_orderkey, file_priority FROM r ORDER BY file_priority DESC, rel, o_totalprice DESC, o_orderkey LIMIT 100""")
def report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4, T5, K3: rows by their file's best priority, then by score; the first hundred."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("rel"), "o_orderkey", "o_totalprice")
    best = orders.groupBy("rel").agg(F.max("o_totalprice").alias("file_priority"))
    return orders.join(best, "rel").orderBy(F.desc("file_priority"), "rel", F.desc("o_totalprice"), "o_orderkey").limit(100).select("rel", "o_orderkey", "file_priority")


@query("""
SELECT DISTINCT c_custkey AS key FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 5000 UNION SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%') WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def union_less_reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of several passes together, once each, less those that another pass used."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), "o_orderpriority", "o_orderstatus")
    passes = read(spark, sf_dir, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("key")).union(orders.filter("o_orderpriority like '1%'").select("key"))
    return passes.distinct().join(orders.filter("o_orderstatus = 'P'"), "key", "left_anti")


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON functions of the readers: a field of a document by a schema."""
    events = read(spark, sf_dir, "events").select("event_type", F.from_json("props", "k bigint").alias("p"))
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("p.k").alias("total"))


@query("""
WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS commit_day FROM orders ORDER BY commit_day DESC LIMIT 200)
SELECT o_custkey AS rel, count(DISTINCT CAST(o_orderdate AS DATE)) AS n, CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR) AS last_modified FROM orders WHERE CAST(o_orderdate AS DATE) IN (SELECT commit_day FROM d) GROUP BY 1""")
def change_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes by file over the last 200 commits."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("rel"), F.to_date("o_orderdate").alias("day"))
    recent = orders.select("day").distinct().orderBy(F.desc("day")).limit(200)
    return orders.join(F.broadcast(recent), "day", "left_semi").groupBy("rel").agg(F.countDistinct("day").alias("n"), F.max("day").cast("string").alias("last_modified"))


@query("""
SELECT p_partkey, CASE WHEN p_size > 40 THEN 'JUDGEMENT' WHEN p_size > 20 THEN 'MECHANICAL' ELSE '' END AS stamp,
 array_to_string(list_filter([CASE WHEN p_size >= 15 THEN 'is complex (' || p_size || ')' END, CASE WHEN p_retailprice >= 1000 THEN 'changes often' END], lambda x: x IS NOT NULL), ' and ') AS facts,
 p_type || CASE WHEN p_brand = 'Brand#11' THEN ' — house rule: keep' ELSE '' END AS message FROM part""")
def finding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stamps, facts lines and guidance of findings as expressions."""
    facts = F.array_join(F.array_compact(F.array(F.when(F.col("p_size") >= 15, F.format_string("is complex (%d)", "p_size")), F.when(F.col("p_retailprice") >= 1000, F.lit("changes often")))), " and ")
    guidance = spark.createDataFrame([("Brand#11", "keep")], "p_brand string, advice string")
    told = read(spark, sf_dir, "part").join(F.broadcast(guidance), "p_brand", "left")
    stamp = F.when(F.col("p_size") > 40, "JUDGEMENT").when(F.col("p_size") > 20, "MECHANICAL").otherwise("")
    return told.select("p_partkey", stamp.alias("stamp"), facts.alias("facts"), F.concat("p_type", F.coalesce(F.concat(F.lit(" — house rule: "), "advice"), F.lit(""))).alias("message"))


@query("""
WITH s AS (SELECT user_id AS rel, event_id AS line, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events WHERE event_type = 'error'),
m AS (SELECT user_id AS rel, event_id AS marker, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events WHERE event_type = 'signup')
SELECT rel, line, marker FROM s JOIN m USING (rel, k)""")
def peel_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites and markers of one line matched one to one from the innermost out; two ranks joined where all match all."""
    w = Window.partitionBy("rel").orderBy(F.desc("line"))
    events = read(spark, sf_dir, "events").select(F.col("user_id").alias("rel"), F.col("event_id").alias("line"), "event_type")
    ranked = lambda kind: events.filter(F.col("event_type") == kind).select("rel", "line", F.row_number().over(w).alias("k"))
    return ranked("error").join(ranked("signup").withColumnRenamed("line", "marker"), ["rel", "k"]).select("rel", "line", "marker")


@query("""
SELECT user_id, min(event_id) AS first_use, min(CASE WHEN event_type = 'signup' THEN event_id END) AS first_binding FROM events GROUP BY 1 HAVING coalesce(min(CASE WHEN event_type = 'signup' THEN event_id END), 9223372036854775807) > min(event_id)""")
def used_before_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names used before their first binding."""
    events = read(spark, sf_dir, "events").groupBy("user_id").agg(F.min("event_id").alias("first_use"), F.min(F.when(F.col("event_type") == "signup", F.col("event_id"))).alias("first_binding"))
    return events.filter("first_binding is null or first_binding > first_use")


@query("""
SELECT l_orderkey, count(DISTINCT l_suppkey) AS modules, count(*) AS uses, count(DISTINCT (l_suppkey, l_partkey)) AS pairs, min(l_linenumber) AS first_site FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 2 ORDER BY modules DESC, uses DESC, l_orderkey LIMIT 200""")
def shared_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several distinct counts of a run, ordered, the first two hundred."""
    runs = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.countDistinct("l_suppkey").alias("modules"), F.count(F.lit(1)).alias("uses"), F.countDistinct("l_suppkey", "l_partkey").alias("pairs"), F.min("l_linenumber").alias("first_site"))
    return runs.filter("modules >= 2").orderBy(F.desc("modules"), F.desc("uses"), "l_orderkey").limit(200)


@query()
def witness_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cycle for each component, as a path from its least node back to it: the shortest one, by breadth-first rounds."""
    edges = settle(flow(spark, sf_dir).filter("src <> dst"))
    inside = graphs.cycles(edges).select(F.col("node"), "label")
    e = settle(edges.join(inside.select(F.col("node").alias("src"), "label"), "src").join(inside.select(F.col("node").alias("dst"), F.col("label").alias("l2")), "dst").filter("label = l2").select("src", "dst", "label"))
    paths = settle(e.filter("src = label").select("label", F.array("src", "dst").alias("path")))
    done = settle(paths.limit(0))
    while True:
        here = F.element_at("path", -1)
        closed = settle(done.union(paths.filter(here == F.col("label"))).groupBy("label").agg(F.min("path").alias("path")))
        left = paths.join(closed.select("label"), "label", "left_anti")
        # one path (the least) to each node of a component is enough for a shortest cycle
        grown = left.join(e.withColumnRenamed("label", "l"), (here == F.col("src")) & (F.col("label") == F.col("l"))).select("label", F.concat("path", F.array("dst")).alias("path"))
        paths = settle(grown.groupBy("label", F.element_at("path", -1).alias("at")).agg(F.min("path").alias("path")).select("label", "path"))
        done = closed
        if paths.isEmpty():
            return done.select("label", F.array_join(F.transform("path", lambda x: x.cast("string")), " -> ").alias("ring"))


@query("SELECT CAST(user_id AS VARCHAR) AS uri, arg_max(props, event_id) AS text, max(event_id) AS seq FROM events GROUP BY 1")
def stream_latest_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of the events table with keyed state; the last row of each key's changes is its latest text."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "false").parquet(sf_dir) if sf_dir.startswith("/") and Path(f"{sf_dir}/events.parquet").is_file() else spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet")
    events = stream.select(F.col("user_id").cast("string").alias("uri"), F.lit("change").alias("event"), F.col("props").alias("text"), F.col("event_id").alias("seq"))
    parts = []
    query_ = buffers.latest_texts(events).writeStream.foreachBatch(lambda df, n: parts.append(settle(df))).option("checkpointLocation", f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}").trigger(availableNow=True).start()
    query_.awaitTermination()
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.groupBy("uri").agg(F.max_by("text", "seq").alias("text"), F.max("seq").alias("seq"))


def _own_source(spark: SparkSession) -> DataFrame:
    """This package's own files: a repository of known, small size that comes with the program."""
    root = Path(__file__).resolve().parents[1]
    rows = [(f"orelode/{p.relative_to(root).as_posix()}", p.read_text()) for p in sorted(root.rglob("*.py")) if "llm" not in p.relative_to(root).parts]
    return spark.createDataFrame(rows, "rel string, content string")


@query()
def self_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S14 to S18, the rules, suppression, P7 to P11, A17, W1: the engine's actions on its own source."""
    from orelode.plans.engine import Engine

    return Engine(spark, _own_source(spark)).actions().select("rel", "line", "function", "signal", "kind", "severity", "raw", "priority", "message")


@query()
def self_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact tables of the engine's own source: counts by kind."""
    from orelode.sources.python_facts import python_facts

    return python_facts(_own_source(spark)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("rel").alias("files"))


@query("""
WITH RECURSIVE l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS url FROM pages), e AS (SELECT l.page_id AS src, p.page_id AS dst FROM l JOIN pages p USING (url)),
r(node) AS (SELECT min(page_id) FROM pages UNION SELECT dst FROM r JOIN e ON src = node)
SELECT page_id FROM pages WHERE page_id NOT IN (SELECT node FROM r)""")
def unreachable_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that no chain of links from the first page reaches."""
    pages = read(spark, sf_dir, "pages")
    links = pages.select(F.col("page_id").alias("src"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("url"))
    edges = links.join(pages.select("url", F.col("page_id").alias("dst")), "url").select("src", "dst")
    found = graphs.reachable(edges, pages.agg(F.min("page_id").alias("node")))
    return pages.select("page_id").join(found.withColumnRenamed("node", "page_id"), "page_id", "left_anti")


@query("""
WITH p AS (SELECT page_id, regexp_extract(url, '://[^/]*(/[^?#]*)', 1) AS path FROM pages)
SELECT page_id, path, CASE WHEN regexp_matches(path, '(^|/)en/[^/]*\\.html$') THEN 'html' WHEN regexp_matches(path, '(^|/)(en|fr)/[^/]*$') THEN 'plain' ELSE 'other' END AS glob FROM p""")
def path_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Globs matched from the right, the first that fits decides."""
    from orelode.functions.text import glob_regex

    path = F.regexp_extract("url", "://[^/]*(/[^?#]*)", 1)
    fits = F.when(path.rlike(glob_regex("en/*.html")), "html").when(path.rlike(glob_regex("en/*")) | path.rlike(glob_regex("fr/*")), "plain").otherwise("other")
    return read(spark, sf_dir, "pages").select("page_id", path.alias("path"), fits.alias("glob"))


@query()
def table_as_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References outside fences, over texts read as Markdown."""
    docs = read(spark, sf_dir, "pages").select(F.col("url").alias("rel"), F.regexp_replace("html", '<a href="([^"]*)"[^>]*>([^<]*)</a>', r"[$2]($1)").alias("content"))
    return readers.markdown_refs(docs)


assert not set(QUERIES) & set(_QUERIES) and not set(ORACLES) & set(_ORACLES)
