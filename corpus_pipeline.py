"""A training-data pipeline over `documents`: language ID, line dedup, near duplicates, decontamination, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) with the documents that its
predecessor kept and returns a DataFrame of the same columns (the last one: packed pieces). run() applies
them in order, each written to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.llm.common import Scratch, table, without_spans
from orelode.llm.decontaminate import decontaminate
from orelode.llm.jaccard import near_duplicates
from orelode.llm.langid import language_id
from orelode.llm.linededup import copy_classes, line_dedup, mostly_shared, row_key
from orelode.llm.packing import best_fit_packing
from orelode.llm.tokens import vocabulary

#: A document whose most likely language has less than this calibrated probability is in none of the languages.
LEAST_SCORE = 0.4
#: A member of a group of ten near duplicates and more would lose most of its characters to line dedup; so would it with this share at least.
SHARED = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text or letters, or like no learned language, go. The model learns from the documents' own labels."""
    plain, name = _numbered(docs)
    out = language_id(plain, keep=tuple(plain.columns), id_col=name["doc_id"], text_col=name["text"], lang_col=name["lang"])
    return _named(out.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)), docs)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten and more documents go. A group of near duplicates, of which the next stage keeps one, would lose most lines to each
    other: texts that would lose SHARED of their characters are held against each other, and copies among them count as one document."""
    scratch = Scratch(spark, "pipeline-lines")
    likely = scratch.keep(mostly_shared(docs.select("doc_id", "text"), min_docs=10, min_chars=1, share=SHARED), "likely")
    classes = scratch.keep(copy_classes(likely, scratch), "classes").withColumnRenamed("class", "_class")
    scratch.drop("likely", "shingles", "sets", "bands", "heads", "links")
    scratch.release()
    plain, name = _numbered(docs)
    classed = plain.withColumn("_key", row_key(plain, name["doc_id"], name["text"])).join(classes.withColumnRenamed("_ld_row", "_key"), "_key", "left").drop("_key")
    return _counted(_named(line_dedup(classed, name["doc_id"], name["text"], min_docs=10, min_chars=1, class_col="_class"), docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 and more, the one of least id stays."""
    return near_duplicates(docs, k=5, num=80, den=100)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; shorter hits in others are cut from their texts."""
    plain, name = _numbered(docs)
    out = decontaminate(plain, table(spark, sf_dir, "benchmark"), name["doc_id"], name["text"], window=13, share=20).filter(~F.col("contaminated"))
    text = F.col(name["text"]).cast("string")
    cut = out.withColumn(name["text"], F.when(F.size("hit_spans") > 0, without_spans(text, F.col("hit_spans"))).otherwise(text))
    return _counted(_named(cut, docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and offset."""
    return best_fit_packing(docs, vocabulary(), 2048).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with names that no operator gives to its results, and the new name of each column."""
    name = {c: f"_in{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*name.values()), name


def _named(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs under their own names."""
    return out.select(*(F.col(f"_in{i}").alias(c) for i, c in enumerate(docs.columns)))


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars, where there is one, follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_shared_lines),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", remove_benchmark),
    ("packing", pack),
]

#: SQL expresses neither the language model nor best-fit packing; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
