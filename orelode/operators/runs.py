"""Runs of words that several texts share, counted by 64-bit keys; only runs that are reported get their words back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orelode.operators.similarity import SLICE, mixed, word_keys
from orelode.operators.tables import release, settle

#: parts of the keys that are counted one after the other, so that a round's shuffle holds this part of the runs
ROUNDS = 2


def run_keys(words: np.ndarray, sizes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, place of the first word) of all runs of n words, rows of `sizes` words being one after the other."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    count = len(words) - n + 1
    key = np.zeros(count, np.uint64)
    for i in range(n):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + words[i : i + count])
    ends = np.repeat(np.cumsum(sizes), sizes)[:count]
    at = np.flatnonzero(np.arange(count) + n <= ends)
    return key[at], at


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        sizes = np.asarray(batch["words"].value_lengths().fill_null(0))
        part = np.cumsum(sizes) // SLICE
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if lo < hi:
                rows = batch.slice(lo, hi - lo)
                yield rows, np.asarray(rows["words"].flatten()).view(np.uint64), sizes[lo:hi]


def shared_runs(df: DataFrame, id_col: str, source_col: str, tokens_col: str, n: int) -> DataFrame:
    """(run, sources, docs, uses, first_doc) of runs of n words with two sources and more and three uses and more.

    A text's repeats are counted before the shuffle. Rounds take a part of the keys each; their counts are settled
    and their shuffle files go. The words of a run come from its first text, by its key.
    """
    spark = df.sparkSession
    base = df.select(F.col(id_col).alias("doc"), F.col(source_col).alias("source"), F.col(tokens_col).alias("tokens")).filter(F.size("tokens") >= n)
    doc_type, source_type = base.schema["doc"].dataType.simpleString(), base.schema["source"].dataType.simpleString()
    keyed = base.select("doc", "source", word_keys(F.col("tokens")).alias("words"))

    def uses_of(part: int):
        def count(batches):
            for rows, words, sizes in _slices(batches):
                key, at = run_keys(words, sizes, n)
                mine = key % np.uint64(ROUNDS) == part
                key, row = key[mine], np.repeat(np.arange(len(sizes)), sizes)[at[mine]]
                order = np.lexsort((key, row))
                key, row = key[order], row[order]
                first = np.ones(len(key), bool)
                first[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
                start = np.flatnonzero(first)
                u, where = np.diff(np.append(start, len(key))), pa.array(row[start])
                yield pa.RecordBatch.from_arrays([pa.array(key[start].view(np.int64)), rows["doc"].take(where), rows["source"].take(where), pa.array(u)], ["h", "doc", "source", "u"])

        return keyed.mapInArrow(count, f"h long, doc {doc_type}, source {source_type}, u long")

    def counted(uses: DataFrame) -> DataFrame:
        """Runs of one use or source go first; all groupings hold the key, so one shuffle serves them."""
        each = Window.partitionBy("h")
        dealt = uses.withColumn("all", F.sum("u").over(each)).withColumn("lo", F.min("source").over(each)).withColumn("hi", F.max("source").over(each))
        sites = dealt.filter("all >= 3 and lo < hi").groupBy("h", "doc", "source").agg(F.sum("u").alias("u"))
        # a document's number of sources is one but where its id stands twice
        docs = sites.groupBy("h", "doc").agg(F.collect_set("source").alias("of"), F.sum("u").alias("u"))
        total = docs.groupBy("h").agg(F.array_distinct(F.flatten(F.collect_set("of"))).alias("of"), F.count("doc").alias("docs"), F.sum("u").alias("uses"), F.min("doc").alias("first_doc"))
        return total.select("h", F.size("of").cast("long").alias("sources"), "docs", "uses", "first_doc").filter("sources >= 2 and uses >= 3")

    found = None
    for part in range(ROUNDS):
        held = settle(counted(uses_of(part)))
        found = held if found is None else found.union(held)
        release(spark)

    def spell(batches):
        for rows, words, sizes in _slices(batches):
            key, at = run_keys(words, sizes, n)
            row = np.repeat(np.arange(len(sizes)), sizes)[at]
            wanted = rows["found"].flatten()
            of = np.repeat(np.arange(len(sizes)), np.asarray(rows["found"].value_lengths()))
            keys = np.asarray(wanted.field("h")).view(np.uint64)
            # runs and wanted keys of a row meet by both being numbered together
            order = np.lexsort((at, key, row))
            pair = np.zeros(len(key) + len(keys), np.dtype([("row", np.int64), ("key", np.uint64)]))
            pair["row"], pair["key"] = np.concatenate((row[order], of)), np.concatenate((key[order], keys))
            _, first, number = np.unique(pair, return_index=True, return_inverse=True)
            here = first[number[len(key) :]]
            hit = np.flatnonzero(here < len(key))
            place = at[order][here[hit]]
            tokens = rows["tokens"].flatten()
            text = pc.binary_join_element_wise(*[tokens.take(pa.array(place + i)) for i in range(n)], " ")
            kept = wanted.take(pa.array(hit))
            yield pa.RecordBatch.from_arrays([text, kept.field("sources"), kept.field("docs"), kept.field("uses"), rows["doc"].take(pa.array(of[hit]))], ["run", "sources", "docs", "uses", "first_doc"])

    wanted = found.groupBy("first_doc").agg(F.collect_list(F.struct("h", "sources", "docs", "uses")).alias("found"))
    texts = base.select("doc", F.concat_ws("\x00", "tokens").alias("text")).join(wanted, F.col("doc").eqNullSafe(F.col("first_doc")))
    split = texts.select("doc", "found", F.split("text", "\x00").alias("tokens")).select("doc", "found", "tokens", word_keys(F.col("tokens")).alias("words"))
    # an id that stands twice may spell a run twice
    return split.mapInArrow(spell, f"run string, sources long, docs long, uses long, first_doc {doc_type}").dropDuplicates(["run"])
