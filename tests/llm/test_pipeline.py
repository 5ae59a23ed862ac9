"""The corpus pipeline's stages on planted cases."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import prose

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def planted(rng):
    item = prose(rng, 40, 9000)
    base = prose(rng, 150, 9000)
    near = base.split()
    near[70] = "edited"
    rows = [(i, prose(rng, rng.randrange(30, 200), 9000) + "\nall rights reserved", "en") for i in range(60)]
    rows += [(100, base, "en"), (101, base, "en"), (102, " ".join(near), None), (110, item, "en"), (111, prose(rng, 1500, 9000) + " " + item + " end", "en"), (120, None, "en"), (121, "", "en"), (122, "1234 !!", "en")]
    rows += [(200 + i, " ".join(rng.choice(["über", "straße", "größe", "für", "wäre"]) for _ in range(60 + i)), "de") for i in range(30)]
    return [(i, t, lang, "s", len(t or "")) for i, t, lang in rows], item


def test_stages(spark, tmp_path):
    rows, item = planted(random.Random(3))
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert [f.name for f in out.schema] == [f.name for f in docs.schema]
        out.write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        ids = {r["doc_id"] for r in docs.collect()}
        if name == "language_id":
            assert ids == {r[0] for r in rows} - {120, 121, 122}
        elif name == "line_dedup":
            assert ids == {r[0] for r in rows} - {120, 121, 122} and not docs.filter("text like '%rights reserved%'").count()
        elif name == "jaccard_join":
            assert 100 in ids and not ids & {101, 102} and set(range(60)) <= ids
        else:
            assert 110 not in ids and set(range(60)) <= ids
            text = docs.filter("doc_id = 111").first()["text"]
            assert item not in text and text.endswith(" end")
            assert docs.filter(F.length("text") != F.col("n_chars")).count() == 0
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.collect()}


def test_boilerplate_goes_and_copies_stay(spark, tmp_path):
    rng = random.Random(8)
    shared, copied = [prose(rng, 20, 9000) for _ in range(3)], prose(rng, 100, 9000)
    rows = [(i, "\n".join([*shared, prose(rng, 40, 9000)])) for i in range(12)]  # 60 % boilerplate
    rows += [(100 + i, "\n".join([copied, f"copy {i % 4}"])) for i in range(24)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCUMENTS)
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_shared_lines(spark, docs, str(tmp_path)).collect()}
    assert out == {i: t.split("\n")[-1] if i < 100 else t for i, t in rows}
