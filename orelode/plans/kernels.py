"""Relational kernels of the maintainability rules, run on the star-schema and text tables.

Each query is the kernel behind one or more rules (the operator ids in its docstring are those of the
inventory); its SQL twin states the same result for an independent engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orelode.functions import text as T
from orelode.operators import graphs, ranking, runs, similarity

#: rows of a partition of data_clump_pairs
CLUMP_ROWS = 100_000

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""
WITH churn AS (SELECT user_id AS file, count(*) AS n FROM events GROUP BY 1),
worst AS (SELECT o_custkey AS file, max(CAST(o_totalprice AS BIGINT)) AS cc FROM orders GROUP BY 1),
ranked AS (SELECT *, row_number() OVER (ORDER BY n DESC, file DESC) AS k, count(*) OVER () AS total FROM churn)
SELECT file, n, coalesce(cc, 0) AS cc FROM ranked LEFT JOIN worst USING (file)
WHERE k <= greatest(CAST(floor(total * 0.1) AS BIGINT), 1) AND n >= 2""")
def hotspot_top_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The busiest tenth by change count, joined with the worst measure per key."""
    churn = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    worst = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("file")).agg(F.max(F.rint("o_totalprice").cast("long")).alias("cc"))
    top = ranking.top_fraction(churn, "n", "file").filter("n >= 2")
    return top.join(worst, "file", "left").select("file", "n", F.coalesce("cc", F.lit(0)).alias("cc"))


@query("""
WITH top AS (SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id DESC LIMIT (SELECT greatest(CAST(floor(count(*) * 0.1) AS BIGINT), 1) FROM documents))
SELECT doc_id, n_chars, CASE WHEN quality IS NULL THEN 'unknown' WHEN quality = 0 THEN 'untested' ELSE 'covered' END AS state FROM top LEFT JOIN labels USING (doc_id)""")
def untested_unknown_vs_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An absent key is unknown, a present one with nothing is untested."""
    top = ranking.top_fraction(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id")
    state = F.when(F.col("quality").isNull(), "unknown").when(F.col("quality") == 0, "untested").otherwise("covered")
    return top.join(read(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "n_chars", state.alias("state"))


@query("""
WITH c AS (SELECT l_partkey AS p_partkey, count(*) AS callers FROM lineitem GROUP BY 1),
t AS (SELECT l_partkey AS p_partkey, count(DISTINCT l_suppkey) AS tests FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
r AS (SELECT p_partkey, coalesce(callers, 0) AS callers, coalesce(tests, 0) AS tests,
  least(100, CASE WHEN coalesce(callers, 0) > 10 THEN 30 WHEN coalesce(callers, 0) > 3 THEN 15 ELSE 0 END + CASE WHEN coalesce(tests, 0) = 0 THEN 30 ELSE 0 END + CASE WHEN regexp_matches(lower(p_name), 'red|blue|green|steel') THEN 40 ELSE 0 END) AS risk
  FROM part LEFT JOIN c USING (p_partkey) LEFT JOIN t USING (p_partkey))
SELECT * FROM r WHERE risk >= 30 ORDER BY risk DESC, p_partkey LIMIT 50""")
def risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored nodes by callers, tests and words of the name; the 50 riskiest."""
    lines = read(spark, sf_dir, "lineitem")
    callers = lines.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("callers"))
    tests = lines.filter("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.countDistinct("l_suppkey").alias("tests"))
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_name").join(callers, "p_partkey", "left").join(tests, "p_partkey", "left").fillna(0, ["callers", "tests"])
    scored = parts.withColumn("risk", T.risk_points(F.col("callers"), F.col("tests") > 0, F.lower("p_name").rlike("red|blue|green|steel")))
    return scored.filter("risk >= 30").orderBy(F.desc("risk"), "p_partkey").limit(50).select("p_partkey", "callers", "tests", "risk")


@query("SELECT event_type AS signal, count(*) AS n FROM events GROUP BY 1")
def census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12, T6."""
    return read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("signal")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH s AS (SELECT event_type AS signal, user_id AS rel, count(*) AS sites FROM events GROUP BY 1, 2),
t AS (SELECT signal, sum(sites) AS total FROM s GROUP BY 1 HAVING sum(sites) >= 10),
a AS (SELECT signal, rel, sites, row_number() OVER (PARTITION BY signal ORDER BY sites DESC, rel) AS k FROM s)
SELECT signal, CAST(total AS BIGINT) AS total, rel AS anchor, sites FROM t JOIN a USING (signal) WHERE k = 1""")
def bulk_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals with ten sites and more, anchored at the key with most (the least key among equals)."""
    sites = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("signal"), F.col("user_id").alias("rel")).agg(F.count(F.lit(1)).alias("sites"))
    best = F.max_by(F.struct("rel", "sites"), F.struct("sites", -F.col("rel"))).alias("a")
    return sites.groupBy("signal").agg(F.sum("sites").alias("total"), best).filter("total >= 10").select("signal", "total", F.col("a.rel").alias("anchor"), F.col("a.sites").alias("sites"))


_WORDS = "list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: length(x) > 0)"


@query(f"""
WITH w AS (SELECT doc_id, {_WORDS} AS t FROM documents),
g AS (SELECT doc_id, len(t) AS len, unnest(list_transform(range(1, len(t)), lambda i: t[i] || chr(1) || t[i + 1])) AS gram FROM w WHERE len(t) >= 2),
c AS (SELECT doc_id, len, gram, count(*) AS c FROM g GROUP BY 1, 2, 3),
n AS (SELECT doc_id, sum(c) AS n FROM c GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.c, b.c)) AS common FROM c a JOIN c b ON a.gram = b.gram AND a.doc_id < b.doc_id AND abs(a.len - b.len) <= greatest(2, a.len // 5) GROUP BY 1, 2)
SELECT a, min(b) AS b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE common * 200 >= 90 * (na.n + nb.n) GROUP BY a""")
def near_duplicate_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bigram Dice of 0.9 within the length band; the first later partner."""
    docs = read(spark, sf_dir, "documents").select("doc_id", T.words(F.col("text")).alias("tokens"))
    return similarity.first_partners(docs, "doc_id", "tokens")


@query(f"""
WITH w AS (SELECT doc_id, lang, source, {_WORDS} AS t FROM documents),
g AS (SELECT doc_id, lang, source, len(t) AS len, unnest(list_transform(range(1, len(t)), lambda i: t[i] || chr(1) || t[i + 1])) AS gram FROM w WHERE len(t) >= 2),
c AS (SELECT doc_id, lang, source, len, gram, count(*) AS c FROM g GROUP BY ALL),
n AS (SELECT doc_id, sum(c) AS n FROM c GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.c, b.c)) AS common FROM c a JOIN c b ON a.gram = b.gram AND a.lang = b.lang AND a.source <> b.source AND a.doc_id < b.doc_id AND abs(a.len - b.len) <= greatest(2, a.len // 5) GROUP BY 1, 2)
SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE common * 200 >= 80 * (na.n + nb.n)
AND (a, b) NOT IN (SELECT x.doc_id, y.doc_id FROM documents x JOIN documents y ON x.text = y.text AND x.doc_id < y.doc_id)""")
def near_duplicate_two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with an equal key (lang) and a differing one (source), less the pairs already reported as equal."""
    docs = read(spark, sf_dir, "documents")
    pairs = similarity.dice_pairs(docs.select("doc_id", "lang", T.words(F.col("text")).alias("tokens")), "doc_id", "tokens", 80, "lang").select("a", "b")
    # texts are told apart by 128 bits, so no pair carries two of them
    left = docs.select(F.col("doc_id").alias("a"), F.col("source").alias("sa"), F.unhex(F.md5("text")).alias("ta"))
    right = docs.select(F.col("doc_id").alias("b"), F.col("source").alias("sb"), F.unhex(F.md5("text")).alias("tb"))
    return pairs.join(left, "a").join(right, "b").filter("sa <> sb and ta <> tb").select("a", "b")


@query(f"""
WITH w AS (SELECT doc_id, source, {_WORDS} AS t FROM documents),
g AS (SELECT doc_id, source, unnest(list_transform(range(1, len(t) - 3), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] || ' ' || t[i + 3] || ' ' || t[i + 4])) AS run FROM w)
SELECT run, count(DISTINCT source) AS sources, count(DISTINCT doc_id) AS docs, count(*) AS uses, min(doc_id) AS first_doc FROM g GROUP BY run HAVING count(DISTINCT source) >= 2 AND count(*) >= 3""")
def shared_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words in two and more modules with their distinct counts and first site."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", T.words(F.col("text")).alias("tokens"))
    return runs.shared_runs(docs, "doc_id", "source", "tokens", 5).filter("sources >= 2 and uses >= 3")


@query("""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents),
b AS (SELECT doc_id, unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || chr(10) || t[i + 1] || chr(10) || t[i + 2])) AS block, unnest(range(1, len(t) - 1)) AS pos FROM l WHERE len(t) >= 3),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, block ORDER BY pos) AS k, min(pos) OVER (PARTITION BY doc_id, block) AS first_pos FROM b)
SELECT doc_id, pos, first_pos FROM r WHERE k = 2""")
def repeated_line_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second place of a window of three lines within a text."""
    lines = read(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n", -1).alias("t")).filter(F.size("t") >= 3)
    blocks = lines.select("doc_id", F.posexplode(F.transform(F.arrays_zip(*[F.slice("t", F.lit(i), F.size("t") - 2).alias(f"t{i}") for i in (1, 2, 3)]), lambda x: F.concat_ws("\n", x["t1"], x["t2"], x["t3"]))).alias("p", "block"))
    places = blocks.groupBy("doc_id", F.xxhash64("block").alias("h"), "block").agg(F.array_sort(F.collect_list(F.col("p").cast("long") + 1)).alias("at")).filter(F.size("at") >= 2)
    return places.select("doc_id", F.get("at", F.lit(1)).alias("pos"), F.get("at", F.lit(0)).alias("first_pos"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
n AS (SELECT doc_id, pos, trim(regexp_replace(lower(line), '[^a-z0-9]+', ' ', 'g')) AS key FROM l)
SELECT key, count(*) AS occurrences, count(DISTINCT doc_id) AS docs, min(doc_id) AS first_doc, CAST(arg_min(pos, (doc_id, pos)) AS BIGINT) AS first_line FROM n WHERE length(key) >= 15 GROUP BY key HAVING count(*) >= 2""")
def duplicate_expression_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised lines that occur twice and more, with the first site."""
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keyed = lines.select("doc_id", F.col("pos").cast("long").alias("pos"), F.trim(F.regexp_replace(F.lower("line"), "[^a-z0-9]+", " ")).alias("key")).filter(F.length("key") >= 15)
    site = F.min(F.struct("doc_id", "pos")).alias("s")
    out = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("occurrences"), F.countDistinct("doc_id").alias("docs"), site).filter("occurrences >= 2")
    return out.select("key", "occurrences", "docs", F.col("s.doc_id").alias("first_doc"), F.col("s.pos").alias("first_line"))


@query("""
SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS only_partial FROM customer
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus <> 'P')""")
def unused_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions without a use of one population; a use of the other picks the message."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    alive = orders.filter("o_orderstatus <> 'P'")
    partial = orders.filter("o_orderstatus = 'P'").select("c_custkey", F.lit(True).alias("p")).distinct()
    return read(spark, sf_dir, "customer").select("c_custkey").join(alive, "c_custkey", "left_anti").join(partial, "c_custkey", "left").select("c_custkey", F.coalesce("p", F.lit(False)).alias("only_partial"))


@query("""
SELECT DISTINCT p_type FROM part WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT event_type FROM events) e WHERE contains(lower(p_type), substr(e.event_type, 1, 2)))""")
def mentioned_in_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in which no literal occurs; the literals are made distinct first, and their small set is a scalar subquery's array."""
    words = read(spark, sf_dir, "events").select(F.substring("event_type", 1, 2).alias("w")).distinct().agg(F.collect_list("w").alias("ws")).scalar()
    names = read(spark, sf_dir, "part").select("p_type").distinct()
    return names.withColumn("ws", words).filter(~F.exists("ws", lambda w: F.lower("p_type").contains(w))).select("p_type")


@query("""
WITH sp AS (SELECT DISTINCT s_nationkey AS dir, l_suppkey AS s, l_partkey AS p FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)
SELECT a.dir, a.s AS a, b.s AS b, count(*) AS shared FROM sp a JOIN sp b ON a.dir = b.dir AND a.p = b.p AND a.s < b.s GROUP BY 1, 2, 3 HAVING count(*) >= 2""")
def sibling_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one directory that share two and more members (equi-join on directory and member)."""
    sp = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).distinct().join(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("s"), F.col("s_nationkey").alias("dir")), "s")
    a, b = sp.alias("a"), sp.alias("b")
    pairs = a.join(b, (F.col("a.dir") == F.col("b.dir")) & (F.col("a.p") == F.col("b.p")) & (F.col("a.s") < F.col("b.s")))
    return pairs.groupBy(F.col("a.dir").alias("dir"), F.col("a.s").alias("a"), F.col("b.s").alias("b")).agg(F.count(F.lit(1)).alias("shared")).filter("shared >= 2")


@query("""
WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n, min(c_custkey) AS c_custkey FROM customer WHERE c_acctbal < 0 GROUP BY 1, 2 HAVING count(*) = 1)
SELECT r_name, n_name, c_mktsegment, c_custkey FROM region JOIN nation ON n_regionkey = r_regionkey JOIN c ON c_nationkey = n_nationkey WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def chain_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of joins to a member that is unique in its group, gated by a semi-join."""
    unique = read(spark, sf_dir, "customer").filter("c_acctbal < 0").groupBy(F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("c_custkey")).filter("n = 1")
    gated = unique.join(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    nations = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return gated.join(nations, "n_nationkey").select("r_name", "n_name", "c_mktsegment", "c_custkey")


@query("SELECT l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem WHERE l_quantity > 45 GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1")
def single_child_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents with exactly one child; least and greatest child tell, so no distinct count is shuffled."""
    out = read(spark, sf_dir, "lineitem").filter("l_quantity > 45").groupBy("l_partkey").agg(F.min("l_suppkey").alias("l_suppkey"), F.max("l_suppkey").alias("hi"))
    return out.filter("l_suppkey = hi").drop("hi")


@query("""
WITH i AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS p FROM lineitem)
SELECT a.p AS a, b.p AS b, count(*) AS functions, min(a.o) AS anchor FROM i a JOIN i b ON a.o = b.o AND a.p < b.p GROUP BY 1, 2 HAVING count(*) >= 3""")
def data_clump_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of parameters that three and more functions take together. A function's set is one array, so pairs come without a self-join; partitions are dealt by the number of rows, so a task's tables don't grow with the input."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("p"))
    parts = lines.count() // CLUMP_ROWS + 1
    sets = lines.dropna().repartition(parts, "o").groupBy("o").agg(F.array_sort(F.collect_set("p")).alias("ps")).filter(F.size("ps") > 1)
    # a row for each member first, so that no row holds the square of a large set
    first = sets.select("o", "ps", F.explode("ps").alias("a"))
    pairs = first.select("o", "a", F.explode(F.filter("ps", lambda y: y > F.col("a"))).alias("b"))
    return pairs.repartition(2 * parts, "a", "b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("functions"), F.min("o").alias("anchor")).filter("functions >= 3")


@query("""
WITH m AS (SELECT o_custkey AS file, o_orderpriority AS community, count(*) AS n FROM orders GROUP BY 1, 2),
d AS (SELECT file, community, row_number() OVER (PARTITION BY file ORDER BY n DESC, community DESC) AS k FROM m),
f AS (SELECT c_nationkey AS dir, community, count(*) AS files FROM d JOIN customer ON c_custkey = file WHERE k = 1 GROUP BY 1, 2),
g AS (SELECT dir, sum(files) AS files, count(*) FILTER (WHERE files >= 2) AS communities FROM f GROUP BY 1)
SELECT dir, CAST(files AS BIGINT) AS files, communities FROM g WHERE files >= 5 AND communities >= 2""")
def folder_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file's dominant community, then folders that mix communities."""
    dominant = ranking.mode_by(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderpriority").alias("community")), "file", "community")
    homes = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file"), F.col("c_nationkey").alias("dir"))
    counts = dominant.join(homes, "file").groupBy("dir", "community").agg(F.count(F.lit(1)).alias("files"))
    return counts.groupBy("dir").agg(F.sum("files").alias("files"), F.count_if(F.col("files") >= 2).alias("communities")).filter("files >= 5 and communities >= 2")


@query("""
WITH g AS (SELECT o_custkey AS file, o_orderstatus AS community, count(*) AS members FROM orders GROUP BY 1, 2)
SELECT file, count(*) AS groups, CAST(sum(members) AS BIGINT) AS members FROM g WHERE members >= 2 GROUP BY 1 HAVING count(*) >= 2 AND sum(members) >= 6""")
def cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose members fall into two and more groups of two and more."""
    groups = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("file"), "o_orderstatus").agg(F.count(F.lit(1)).alias("members")).filter("members >= 2")
    return groups.groupBy("file").agg(F.count(F.lit(1)).alias("groups"), F.sum("members").alias("members")).filter("groups >= 2 and members >= 6")


@query("""
WITH d AS (SELECT c_nationkey AS dir, count(*) AS modules, count(*) FILTER (WHERE c_acctbal < 0) AS docs FROM customer GROUP BY 1 HAVING count(*) >= 20),
t AS (SELECT DISTINCT s_nationkey AS dir, s_suppkey, unnest(string_split(lower(s_name), '#')) AS token FROM supplier),
k AS (SELECT dir, token, count(*) AS n FROM t WHERE length(token) > 0 GROUP BY 1, 2),
r AS (SELECT dir, token, n, row_number() OVER (PARTITION BY dir ORDER BY n DESC, token) AS k FROM k)
SELECT d.dir, modules, docs, token, n FROM d JOIN r ON r.dir = d.dir WHERE k <= 3""")
def flat_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crowded folders with pivoted counts and their three most frequent name tokens."""
    dirs = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("dir")).agg(F.count(F.lit(1)).alias("modules"), F.count_if(F.col("c_acctbal") < 0).alias("docs")).filter("modules >= 20")
    tokens = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("dir"), F.explode(F.array_distinct(F.split(F.lower("s_name"), "#"))).alias("token")).filter("length(token) > 0").groupBy("dir", "token").agg(F.count(F.lit(1)).alias("n"))
    top = tokens.withColumn("k", F.row_number().over(Window.partitionBy("dir").orderBy(F.desc("n"), "token"))).filter("k <= 3").drop("k")
    return dirs.join(top, "dir")


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_extendedprice DESC, l_linenumber) AS k FROM lineitem)
SELECT l_orderkey, l_returnflag, l_extendedprice, l_linenumber, l_partkey FROM r WHERE k = 1""")
def dedupe_keep_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per key, the largest measure, the earliest among equals."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_extendedprice", "l_linenumber", "l_partkey")
    return ranking.keep_best(lines, ["l_orderkey", "l_returnflag"], "l_extendedprice", "l_linenumber")


@query("""
SELECT l_orderkey, max(l_extendedprice) AS raw, min(l_linenumber) AS line, bool_or(l_returnflag = 'R') AS any_fail, array_to_string(list_sort(list(DISTINCT l_linestatus)), ',') AS kinds, string_agg(l_returnflag, ';' ORDER BY l_linenumber, l_returnflag) AS notes FROM lineitem GROUP BY 1""")
def merge_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of one target merged: worst score, first line, any failure, kinds, notes in order."""
    notes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))), lambda x: x["l_returnflag"]), ";")
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("raw"), F.min("l_linenumber").alias("line"), F.bool_or(F.col("l_returnflag") == "R").alias("any_fail"), F.array_join(F.array_sort(F.collect_set("l_linestatus")), ",").alias("kinds"), notes.alias("notes"))


@query("""
WITH m AS (SELECT min(n_chars) AS lo, max(n_chars) AS hi FROM documents)
SELECT doc_id, CASE WHEN hi <= lo THEN 99 ELSE greatest(1, CAST(round_even(1 + 98 * CAST(n_chars - lo AS DOUBLE) / (hi - lo), 0) AS INTEGER)) END AS priority FROM documents, m""")
def minmax_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1 to 99 by min-max scaling with half-even rounding."""
    return ranking.minmax_rank(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars").select("doc_id", "priority")


@query("""
WITH cur AS (SELECT DISTINCT o_custkey AS key FROM orders WHERE o_orderkey % 2 = 0), base AS (SELECT DISTINCT o_custkey AS key FROM orders WHERE o_orderkey % 2 = 1)
SELECT 'ack' AS state, key FROM cur WHERE key IN (SELECT key FROM base) UNION ALL SELECT 'new', key FROM cur WHERE key NOT IN (SELECT key FROM base) UNION ALL SELECT 'stale', key FROM base WHERE key NOT IN (SELECT key FROM cur)""")
def baseline_ack_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides marked and grouped by key once, instead of a semi-join and two anti-joins."""
    orders = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.bool_or(F.col("o_orderkey") % 2 == 0).alias("cur"), F.bool_or(F.col("o_orderkey") % 2 == 1).alias("base"))
    return orders.select(F.expr("case when cur and base then 'ack' when cur then 'new' else 'stale' end").alias("state"), "key")


@query("""
SELECT f.event_id, count(*) AS markers, min(m.event_id) AS first_marker FROM events f JOIN events m ON m.user_id = f.user_id AND m.event_type = f.event_type AND (m.event_id = f.event_id - 1 OR m.event_id BETWEEN f.event_id - 40 AND f.event_id - 39) GROUP BY 1""")
def marker_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings and markers in a window of lines: the window's lines are exploded, and the join is an equi-join."""
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    window = events.select("event_id", "user_id", "event_type", F.explode(F.array(F.col("event_id") - 1, F.col("event_id") - 40, F.col("event_id") - 39)).alias("line"))
    markers = events.select(F.col("event_id").alias("line"), "user_id", "event_type")
    return window.join(markers, ["line", "user_id", "event_type"]).groupBy("event_id").agg(F.count(F.lit(1)).alias("markers"), F.min("line").alias("first_marker"))


@query("""
SELECT count(*) FILTER (WHERE event_type = 'click') AS fails, count(*) FILTER (WHERE event_type = 'view') AS warns, count(*) FILTER (WHERE event_type NOT IN ('click', 'view')) AS ack, count(*) AS total, count(DISTINCT (user_id, event_type)) AS targets FROM events""")
def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger in one aggregation."""
    kind = F.col("event_type")
    return read(spark, sf_dir, "events").agg(F.count_if(kind == "click").alias("fails"), F.count_if(kind == "view").alias("warns"), F.count_if(~kind.isin("click", "view")).alias("ack"), F.count(F.lit(1)).alias("total"), F.countDistinct("user_id", "event_type").alias("targets"))


@query("""
WITH n AS (SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, kind) AS k FROM n)
SELECT CASE WHEN k <= 2 THEN kind ELSE '+rest' END AS kind, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1""")
def kind_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent kinds, the rest as one."""
    n = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    top = n.orderBy(F.desc("n"), "kind").limit(2).select("kind", F.lit(True).alias("top"))
    return n.join(F.broadcast(top), "kind", "left").groupBy(F.when(F.col("top"), F.col("kind")).otherwise("+rest").alias("kind")).agg(F.sum("n").alias("n"))


@query("""
WITH l AS (SELECT l_partkey, l_linenumber, max(CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END) AS hits FROM lineitem GROUP BY 1, 2),
c AS (SELECT p_brand, count(*) FILTER (WHERE hits > 0) AS covered, count(*) AS valid FROM l JOIN part ON p_partkey = l_partkey GROUP BY ROLLUP (p_brand))
SELECT coalesce(p_brand, 'total') AS package, covered, valid, round(covered * 100.0 / valid, 4) AS rate, CASE WHEN covered * 100 >= 60 * valid THEN 'target' WHEN covered * 100 >= 50 * valid THEN 'minimum' ELSE 'below' END AS bar FROM c""")
def coverage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate lines collapse to most hits; rates by package and in total against two bars."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_linenumber").agg(F.max(F.when(F.col("l_returnflag") == "N", 0).otherwise(1)).alias("hits"))
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    rolled = lines.join(parts, "l_partkey").rollup("p_brand").agg(F.count_if(F.col("hits") > 0).alias("covered"), F.count(F.lit(1)).alias("valid"))
    bar = F.expr("case when covered * 100 >= 60 * valid then 'target' when covered * 100 >= 50 * valid then 'minimum' else 'below' end")
    return rolled.select(F.coalesce("p_brand", F.lit("total")).alias("package"), "covered", "valid", F.round(F.col("covered") * 100.0 / F.col("valid"), 4).alias("rate"), bar.alias("bar"))


_FLOW = "SELECT DISTINCT a.n_nationkey AS src, b.n_nationkey AS dst FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation a ON a.n_nationkey = c_nationkey JOIN nation b ON b.n_regionkey = a.n_regionkey AND b.n_nationkey % 5 = o_orderkey % 5 WHERE a.n_nationkey <> 13"


def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph of nations: an order leads from its customer's nation to one of the region, chosen by its key; nation 13 has no way out."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), (F.col("o_orderkey") % 5).alias("k")).join(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    from_to = orders.select("c_nationkey", "k").distinct()
    nation = read(spark, sf_dir, "nation")
    a, b = nation.select(F.col("n_nationkey").alias("src"), "n_regionkey"), nation.select(F.col("n_nationkey").alias("dst"), "n_regionkey", (F.col("n_nationkey") % 5).cast("long").alias("k"))
    return from_to.join(a, F.col("c_nationkey") == F.col("src")).join(b, ["n_regionkey", "k"]).filter("src <> 13").select("src", "dst").distinct()


@query(f"WITH RECURSIVE e AS ({_FLOW}), r(node) AS (SELECT 4 UNION SELECT dst FROM r JOIN e ON src = node) SELECT node FROM r")
def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything reachable in any number of hops."""
    return graphs.reachable(flow(spark, sf_dir), spark.range(4, 5).select(F.col("id").cast("int").alias("node")))


@query(f"""
WITH RECURSIVE e AS ({_FLOW}), r(a, b) AS (SELECT src, dst FROM e WHERE src <> dst UNION SELECT a, dst FROM r JOIN e ON src = b),
s AS (SELECT x.a AS node, x.b AS other FROM r x JOIN r y ON x.a = y.b AND x.b = y.a)
SELECT node, min(least(node, other)) AS label, count(DISTINCT other) AS size FROM s GROUP BY node HAVING count(DISTINCT other) >= 2""")
def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strongly connected components of two nodes and more."""
    return graphs.cycles(flow(spark, sf_dir)).select("node", "label", "size")


@query(f"""
WITH RECURSIVE e AS ({_FLOW}), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r(a, b) AS (SELECT src, dst FROM b UNION SELECT r.a, b.dst FROM r JOIN b ON b.src = r.b)
SELECT a AS node, least(a, min(b)) AS label FROM r GROUP BY a""")
def seam_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of an undirected link table."""
    return graphs.components(flow(spark, sf_dir))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
f AS (SELECT doc_id, pos, sum(CASE WHEN length(line) % 5 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) % 2 AS fenced FROM l)
SELECT doc_id, CAST(sum(fenced) AS BIGINT) AS fenced_lines, count(*) AS lines FROM f GROUP BY 1""")
def fence_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines inside fences, by the parity of fence lines so far; one fold over a text's lines, no shuffle."""
    lines = F.split("text", "\n", -1)
    start = F.struct(F.lit(0).alias("open"), F.lit(0).cast("long").alias("n"))

    def step(state, line):
        now = (state["open"] + F.when(F.length(line) % 5 == 0, 1).otherwise(0)) % 2
        return F.struct(now.alias("open"), (state["n"] + now).alias("n"))

    return read(spark, sf_dir, "documents").select("doc_id", F.aggregate(lines, start, step, lambda s: s["n"]).alias("fenced_lines"), F.size(lines).cast("long").alias("lines"))


@query("""
WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages)
SELECT page_id, target FROM h WHERE target NOT IN (SELECT url FROM pages) GROUP BY ALL""")
def dead_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link targets that don't exist."""
    pages = read(spark, sf_dir, "pages")
    found = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target")).distinct()
    return found.join(pages.select(F.col("url").alias("target")), "target", "left_anti").select("page_id", "target")


@query("""
WITH w AS (SELECT item_id, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: length(x) >= 3)) AS t FROM benchmark),
d AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: length(x) >= 3)) AS t FROM documents),
i AS (SELECT item_id, len(t) AS n, unnest(t) AS word FROM w), j AS (SELECT doc_id, unnest(t) AS word FROM d)
SELECT item_id, doc_id, count(*) AS shared, n AS words FROM i JOIN j USING (word) GROUP BY item_id, doc_id, n HAVING n >= 5 AND count(*) * 100 >= 50 * n""")
def restating_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that hold half of an item's content words and more."""
    item = read(spark, sf_dir, "benchmark").select("item_id", T.content_words(F.col("text")).alias("t")).filter(F.size("t") >= 5).select("item_id", F.size("t").cast("long").alias("words"), F.explode("t").alias("word"))
    docs = read(spark, sf_dir, "documents").select("doc_id", F.explode(T.content_words(F.col("text"))).alias("word"))
    return docs.join(item, "word").groupBy("item_id", "doc_id", "words").agg(F.count(F.lit(1)).alias("shared")).filter("shared * 100 >= 50 * words").select("item_id", "doc_id", "shared", "words")


@query("""
WITH i(ord, pat, signal) AS (VALUES (0, NULL, 'error'), (1, 1, 'click'), (2, 3, 'view'))
SELECT e.event_type AS signal, count(*) AS ignored FROM events e WHERE EXISTS (SELECT 1 FROM i WHERE i.signal = e.event_type AND (pat IS NULL OR e.user_id % 4 = pat)) GROUP BY 1""")
def config_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: findings that a configured ignore list (global, or by pattern) takes out, counted by signal."""
    ignores = spark.createDataFrame([(None, "error"), (1, "click"), (3, "view")], "pat int, signal string")
    events = read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("signal"), (F.col("user_id") % 4).alias("u"))
    hit = events.join(F.broadcast(ignores), (events.signal == ignores.signal) & (F.col("pat").isNull() | (F.col("u") == F.col("pat"))), "left_semi")
    return hit.groupBy("signal").agg(F.count(F.lit(1)).alias("ignored"))


@query("WITH b AS (SELECT event_id, unnest(range(0, 20)) AS bit FROM events) SELECT event_id, bit AS line FROM b WHERE (event_id >> CAST(bit AS INTEGER)) & 1 = 1")
def line_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The set bits of a packed number as rows."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(19)), lambda i: F.getbit("event_id", i) == 1)
    return read(spark, sf_dir, "events").select("event_id", F.explode(bits).alias("line")).select("event_id", F.col("line").cast("long").alias("line"))


@query("""
WITH p AS (SELECT page_id, list_filter(string_split(regexp_extract(url, '://([^?#]*)', 1), '/'), lambda x: length(x) > 0) AS parts FROM pages)
SELECT page_id, CASE WHEN len(parts) >= 2 THEN parts[1] || '/' || parts[2] ELSE coalesce(parts[1], '') END AS module FROM p""")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path's first two parts."""
    parts = F.filter(F.split(F.regexp_extract("url", "://([^?#]*)", 1), "/"), lambda x: F.length(x) > 0)
    return read(spark, sf_dir, "pages").select("page_id", F.array_join(F.slice(parts, 1, 2), "/").alias("module"))


@query("SELECT coalesce(l_returnflag, 'all') AS flag, coalesce(l_linestatus, 'all') AS status, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), (l_returnflag, l_linestatus), ())")
def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by kind, by group and over all."""
    cube = read(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").cube("l_returnflag", "l_linestatus")
    return cube.agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("total")).select(F.coalesce("l_returnflag", F.lit("all")).alias("flag"), F.coalesce("l_linestatus", F.lit("all")).alias("status"), "n", "total")


@query("SELECT l_suppkey, round(avg(l_quantity), 6) AS average, CASE WHEN ceil(avg(l_quantity) / 10) <= 1 THEN 'A' WHEN ceil(avg(l_quantity) / 10) = 2 THEN 'B' WHEN ceil(avg(l_quantity) / 10) = 3 THEN 'C' ELSE 'D' END AS rank, count(*) AS blocks FROM lineitem GROUP BY 1")
def block_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages and letter ranks."""
    grouped = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("a"), F.count(F.lit(1)).alias("blocks"))
    step = F.ceil(F.col("a") / 10)
    return grouped.select("l_suppkey", F.round("a", 6).alias("average"), F.when(step <= 1, "A").when(step == 2, "B").when(step == 3, "C").otherwise("D").alias("rank"), "blocks")


@query("""
WITH r AS (SELECT event_id, user_id, event_type = 'click' AS hit, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
g AS (SELECT *, n - row_number() OVER (PARTITION BY user_id, hit ORDER BY event_id) AS island FROM r)
SELECT user_id, min(event_id) AS first_id, max(event_id) AS last_id, count(*) AS arms FROM g WHERE hit GROUP BY user_id, island HAVING count(*) >= 3""")
def contiguous_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of three and more adjacent hits (gaps and islands)."""
    hit = F.col("event_type") == "click"
    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", hit.alias("hit")).withColumn("n", F.row_number().over(w)).withColumn("misses", F.sum(F.when(F.col("hit"), 0).otherwise(1)).over(w))
    runs = rows.filter("hit").groupBy("user_id", "misses").agg(F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.count(F.lit(1)).alias("arms"))
    return runs.filter("arms >= 3").drop("misses")


@query("""
WITH s AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) = 'purchase' AS after_exit FROM events)
SELECT user_id, min(event_id) AS event_id FROM s WHERE after_exit GROUP BY 1""")
def after_exit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first statement after an exit in each list."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    steps = read(spark, sf_dir, "events").select("user_id", "event_id", (F.lag("event_type").over(w) == "purchase").alias("x"))
    return steps.filter("x").groupBy("user_id").agg(F.min("event_id").alias("event_id"))


@query("""
WITH m AS (SELECT l_orderkey AS o, list(DISTINCT l_suppkey) AS s FROM lineitem WHERE l_quantity > 40 GROUP BY 1)
SELECT a.o AS small, b.o AS large FROM m a JOIN m b ON a.o <> b.o AND list_has_all(b.s, a.s) AND len(a.s) >= 2 AND len(b.s) > len(a.s)""")
def subset_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Member sets wholly inside a larger one: set pairs meet on members, and a full count is containment."""
    sets = read(spark, sf_dir, "lineitem").filter("l_quantity > 40").groupBy(F.col("l_orderkey").alias("o")).agg(F.collect_set("l_suppkey").alias("s")).filter(F.size("s") >= 2)
    each = sets.select("o", F.size("s").alias("n"), F.explode("s").alias("m"))
    a, b = each.alias("a"), each.alias("b")
    both = a.join(b, (F.col("a.m") == F.col("b.m")) & (F.col("a.n") < F.col("b.n"))).groupBy(F.col("a.o").alias("small"), F.col("b.o").alias("large"), F.col("a.n").alias("n")).agg(F.count(F.lit(1)).alias("met"))
    return both.filter("met = n").select("small", "large")


@query("""
WITH k AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages)
SELECT page_id, (contains(host, 'test') OR starts_with(host, 'blog')) AS core_test, regexp_matches(host, '(^|\\.)(tests|blog)(\\.|$)') AS gate_test, len(string_split(host, '.')) AS depth FROM k""")
def path_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two path predicates side by side, by substring and by whole segment."""
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    return read(spark, sf_dir, "pages").select("page_id", (host.contains("test") | host.startswith("blog")).alias("core_test"), host.rlike(r"(^|\.)(tests|blog)(\.|$)").alias("gate_test"), F.size(F.split(host, r"\.")).cast("long").alias("depth"))


@query("""
SELECT o_orderkey, round(sqrt(1 + least(c.n / 30.0, 1.5)) * least(o_totalprice / 40000, 1.0), 6) AS raw FROM orders JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) c USING (o_custkey)""")
def raw_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measure times churn factor."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    churn = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return orders.join(churn, "o_custkey").select("o_orderkey", F.round(T.churn_factor(F.col("n")) * F.least(F.col("o_totalprice") / 40000, F.lit(1.0)), 6).alias("raw"))
