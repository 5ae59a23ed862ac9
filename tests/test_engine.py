"""Sources, suppression, ranking, baseline, reports, documents and streams."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from orelode.functions import text as T
from orelode.plans import docs_rules, gate
from orelode.plans.engine import Engine, families
from orelode.sources import readers
from orelode.sources.rust_facts import rust_facts
from orelode.streaming import buffers

FINDINGS = "rel string, line int, function string, signal string, kind string, severity string, message string"
MARKERS = "rel string, line int, signal string, why string, scope string"


def finding(rel, line, signal, function="f", severity="fail", kind=None):
    return (rel, line, function, signal, kind or signal, severity, f"{signal} {line}")


def test_suppression(spark):
    found = spark.createDataFrame([finding("a", 10, "x"), finding("a", 10, "x", "g"), finding("a", 20, "wide-tuple"), finding("a", 31, "x"), finding("b", 5, "y"), finding("c", 9, "x")], FINDINGS)
    markers = spark.createDataFrame([("a", 9, "x", "why", "line"), ("a", 20, "latent-class", "why", "line"), ("a", 29, "x", "why", "line"), ("b", 1, "y", "why", "file"), ("c", 9, "x", "", "line"), ("c", 50, "z", "why", "line")], MARKERS)
    logical = spark.createDataFrame([("a", n, 30) for n in (30, 31, 32)], "rel string, line int, start int")
    left, used = gate.suppress(found, markers, logical, families())
    # one of two sites on line 10; the family covers its variant; the statement's first line counts; file scope; a marker needs a why
    assert sorted((r["rel"], r["line"]) for r in left.collect()) == [("a", 10), ("c", 9)]
    stale = gate.stale_markers(found, markers, used, families()).collect()
    assert [(r["rel"], r["line"]) for r in stale] == [("c", 50)]


def test_config(spark):
    config = readers.Config({"ignore": ["a"], "per-glob": {"*/gen/*.py": {"ignore": ["b"]}, "*.py": {"ignore": ["c"]}}, "guidance": {"unused": "ask first", "nothing": "x"}}, families())
    found = spark.createDataFrame([finding("m.py", 1, "a"), finding("x/gen/m.py", 1, "b"), finding("x/gen/m.py", 1, "c"), finding("m.py", 1, "c"), finding("m.py", 2, "unused")], FINDINGS)
    kept, counts = gate.apply_config(found, config)
    assert sorted((r["rel"], r["signal"]) for r in kept.collect()) == [("m.py", "unused"), ("x/gen/m.py", "c")]
    assert {r["signal"]: r["n"] for r in counts.collect()} == {"a": 1, "b": 1, "c": 1}
    assert "house rule: ask first" in kept.filter("signal = 'unused'").first()["message"]
    assert readers.Config({"ignore": ["group:latent-class"]}, families()).ignores == families()["latent-class"]


@pytest.mark.parametrize(("pattern", "path", "fits"), [("*.py", "a/b.py", True), ("a/*.py", "x/a/b.py", True), ("a/*.py", "a/x/b.py", False), ("**/b.py", "a/b.py", True), ("[!a].py", "b.py", True), ("[!a].py", "a.py", False), ("/a.py", "x/a.py", False)])
def test_globs(spark, pattern, path, fits):
    assert spark.range(1).select(F.lit(path).rlike(T.glob_regex(pattern))).first()[0] is fits


def test_actions_and_baseline(spark, tmp_path):
    found = spark.createDataFrame([finding("a.py", 1, "complexity"), finding("a.py", 1, "complexity"), finding("a.py", 7, "unused", "f", "warn"), finding("tests/test_a.py", 3, "complexity"), finding("tests/test_a.py", 4, "monkeypatch")], FINDINGS)
    churn = spark.createDataFrame([("a.py", 30)], "rel string, n bigint")
    acts = gate.dedupe_and_rank(gate.actions(found, churn))
    rows = acts.collect()
    assert {(r["rel"], r["signal"]) for r in rows} == {("a.py", "complexity"), ("a.py", "unused"), ("tests/test_a.py", "monkeypatch")}
    assert max(r["priority"] for r in rows) == 99 and min(r["priority"] for r in rows) == 1
    merged = {(r["rel"], r["function"]): r for r in gate.merge_targets(acts).collect()}
    assert merged["a.py", "f"]["fails"] == 1 and merged["a.py", "f"]["line"] == 1 and merged["a.py", "f"]["kinds"] == ["complexity", "unused"]
    gate.write_baseline(acts, str(tmp_path / "base"))
    keys, odd = readers.baseline(spark, str(tmp_path / "base"))
    assert odd == 0 and {r["key"] for r in keys.collect()} == {"complexity:a.py:1:f", "monkeypatch:tests/test_a.py:4:f"}
    known, stale = gate.against_baseline(acts, keys.union(spark.createDataFrame([("complexity:a.py:2:f",)], "key string")))
    result = gate.verdict(known, stale)
    assert (result.fails, result.warns, result.ack, result.stale, result.exit_code) == (0, 1, 2, 1, 1)
    assert gate.verdict(known, stale, warn_only=True).exit_code == 0
    text = gate.render_text(known, result)
    assert "GATE: FAIL" in text and "a.py" in text
    gate.report_json(known, result, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report/actions")).count() == 3
    assert gate.seam_clusters(acts, 2).count() >= 2
    assert gate.facts_line(acts.withColumn("churn", F.lit(12))).filter("note like 'changes often%' or note like '%and changes often%'").count() == 3


def test_engine_end_to_end(spark):
    files = {
        "AGENTS.md": "see [docs](docs/a.md) and `docs/b.md`\n```\n[no](nowhere.md)\n```\n[gone](docs/gone.md#x) [web](https://x.y)\n", "docs/a.md": "text", "docs/b.md": "text", "docs/lost.md": "text",
        "pkg/a.py": "def f(x):\n    # quality: ignore magic-number the limit\n    return x * 37\n", "pkg/b.py": "def g(x):\n    # quality: ignore swallow no reason to be here\n    return x * 41\n",
        "src/lib.rs": "mod a;\nuse crate::a::T;\npub fn f(v: Vec<u8>) -> u8 { v.first().unwrap() }\n", "src/a.rs": "use crate::f;\npub struct T { x: u8 }\n#[cfg(test)]\nmod tests { #[test] fn t() { let a = b.unwrap(); } }\n",
    }
    acts, result = Engine(spark, spark.createDataFrame(list(files.items()), "rel string, content string")).run()
    got = {(r["rel"], r["signal"]) for r in acts.collect()}
    assert {("pkg/b.py", "magic-number"), ("pkg/b.py", "stale-suppression"), ("AGENTS.md", "docs-link"), ("docs/lost.md", "docs-undiscoverable"), ("src/lib.rs", "debug-artifact")} <= got
    assert ("pkg/a.py", "magic-number") not in got and ("src/a.rs", "debug-artifact") not in got and ("docs/b.md", "docs-undiscoverable") not in got
    assert result.exit_code == 1


def test_readers(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg/a.py").write_text("x = 1\n")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/b.py").write_text("y = 1\n")
    assert {r["rel"] for r in readers.walked_files(spark, str(tmp_path)).collect()} == {"pkg/a.py"}
    xml = '<coverage><packages><package><classes><class filename="a.py"><lines><line number="1" hits="0"/><line number="1" hits="2"/><line number="x" hits="1"/></lines></class><class filename="b.py"><lines/></class></classes></package></packages></coverage>'
    (tmp_path / "coverage.xml").write_text(xml)
    assert {r["rel"]: r["lines"] for r in readers.load_coverage(spark, str(tmp_path)).collect()} == {"a.py": [1], "b.py": []}
    db = sqlite3.connect(tmp_path / "cov")
    db.executescript("create table file(id integer, path text); create table line_bits(file_id integer, numbits blob)")
    db.execute("insert into file values (1, 'a.py'), (2, 'b.py')")
    db.execute("insert into line_bits values (1, ?)", (bytes([0b00000110, 0b00000001]),))
    db.commit()
    assert {r["rel"]: r["lines"] for r in readers.coverage_sqlite(spark, str(tmp_path / "cov")).collect()} == {"a.py": [1, 2, 8], "b.py": []}
    (tmp_path / "g.json").write_text(json.dumps({"contract_version": 1, "nodes": [{"kind": "Function", "name": "f", "qualified_name": "m.f", "file_path": "m.py"}], "edges": [], "communities": {}}))
    assert readers.graph(spark, str(tmp_path / "g.json"))[0].first()["name"] == "f"
    (tmp_path / "g2.json").write_text(json.dumps({"contract_version": 2}))
    assert readers.graph(spark, str(tmp_path / "g2.json")) is None
    (tmp_path / "pyproject.toml").write_text('[tool.quality]\nignore = ["swallow"]\n')
    assert readers.Config.load(str(tmp_path), families()).ignores == ["swallow"]


def test_history(spark):
    rows = [("c1", 1_000, "a.py"), ("c1", 1_000, "x.txt"), ("c2", 2_000, "a.py"), ("c2", 2_000, "node_modules/b.py")]
    commits = spark.createDataFrame(rows, "commit string, s bigint, file string").select("commit", (F.current_timestamp() - F.make_dt_interval(secs=F.lit(9_000) - F.col("s"))).alias("ts"), "file")
    assert [(r["rel"], r["n"]) for r in readers.file_history(commits).collect()] == [("a.py", 2)]
    assert [(r["rel"], r["n"]) for r in readers.file_history(commits, most=1).collect()] == [("a.py", 1)]


def test_markdown(spark):
    docs = spark.createDataFrame([("docs/x/a.md", "[up](../b.md#part) [dead](c.md) `d.md` [mail](mailto:a@b)\n```\n[in](fence.md)\n```"), ("docs/b.md", "")], "rel string, content string")
    assert {(r["line"], r["target"]) for r in docs_rules.docs_links(docs, docs).collect()} == {(1, "docs/x/c.md")}


def test_rust(spark):
    source = 'pub fn big(a: u8, b: u8, c: u8, d: u8, e: u8, f: u8) -> u8 { if a > 1 && b > 2 { "if {" ; 1 } else { 2 } } // if\n\n\n#[allow(dead_code)]\nfn g() { let _ = h(); }\n'
    rows = rust_facts(spark.createDataFrame([("src/a.rs", source), ("src/e.rs", None)], "rel string, content string")).collect()
    functions = {r["name"]: r for r in rows if r["kind"] == "function"}
    assert functions["big"]["a"] == 6 and functions["big"]["b"] == 3 and {r["kind"] for r in rows} >= {"handler", "bare_ignore", "module"}


def test_stream(spark, tmp_path):
    source = tmp_path / "events"
    source.mkdir()
    batches = [[("a", "open", "def f(x):\n    return x * 37\n", 1), ("b", "open", "x = 1\n", 1)], [("a", "change", "def f(x):\n    return x\n", 3), ("a", "change", "def f(x):\n    return x * 99\n", 2), ("b", "close", None, 2)]]
    got = []
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, buffers.EVENTS).coalesce(1).write.json(f"{source}/{n}")
        stream = spark.readStream.schema(buffers.EVENTS).json(f"{source}/*")
        query = buffers.publish(stream, lambda df, number: got.append([(r["uri"], r["line0"], r["signal"]) for r in df.collect()]), str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert ("a", 1, "magic-number") in got[0] and not [x for x in got[-1] if x[2] == "magic-number"]
    table = spark.createDataFrame([r for b in batches for r in b], buffers.EVENTS)
    assert [(r["uri"], r["text"]) for r in buffers.latest_batch(table).collect()] == [("a", "def f(x):\n    return x\n")]
