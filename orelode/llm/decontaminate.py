"""Benchmark decontamination: one Aho-Corasick automaton over normalised questions and answers.

A word of the benchmark's vocabulary is one symbol, every other word the same foreign symbol, so a
text of n words is a string of n symbols and each window of an item is a pattern of at most `window`
symbols. The automaton reads each whole text once. Words keep their byte ranges, so runs of hit words
come back as code-point spans of the original text.

The benchmark is broadcast in slices of at most `slice_bytes` (measured first); one slice is the usual
case, and more of them are scanned one after another with their hits joined, so that no size of the
benchmark is too large.

Defined results: null or empty texts, and texts without words, have no hits; null, empty and wordless
items have no window; items with the same text all count; null item ids count as ''. Repeated rows
and extra columns are kept row by row; columns named like a result are replaced by it. An empty table gives no row.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelode.llm.common import Scratch
from orelode.llm.tokens import chunks, held

#: A-Z lower-cased; every byte outside words [0-9a-z\x80-\xff] a space. Code points over 127 are bytes over 127.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_FOREIGN = "\0"
RESULTS = ("n_words", "n_hit", "hit_items", "hit_spans", "contaminated")


def words(text: str) -> list[bytes]:
    return text.encode().translate(_WORDS).split()


def symbol(i: int) -> str:
    """The i-th symbol: code points from 1 on without surrogates."""
    i += 1
    return chr(i if i < 0xD800 else i + 0x800)


class Windows:
    """The automaton of one slice of (item id, text)."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        import ahocorasick

        self.symbols: dict[bytes, str] = {}
        owners: dict[str, set[int]] = {}
        self.names = [name for name, _ in items]
        for k, (_, text) in enumerate(items):
            coded = "".join([self.symbols.setdefault(w, symbol(len(self.symbols))) for w in words(text)])
            for i in range(max(1, len(coded) - window + 1) if coded else 0):
                owners.setdefault(coded[i : i + window], set()).add(k)
        self.automaton = ahocorasick.Automaton()
        for pattern, at in owners.items():
            self.automaton.add_word(pattern, (len(pattern), tuple(at)))
        if owners:
            self.automaton.make_automaton()
        self.any = bool(owners)

    def hits(self, found: list[bytes]) -> tuple[np.ndarray | None, set[int]]:
        """A mark per word (None without hits) and the items whose windows occur."""
        items: set[int] = set()
        mark = None
        if self.any and found:
            get = self.symbols.get
            for end, (n, at) in self.automaton.iter("".join([get(w, _FOREIGN) for w in found])):
                if mark is None:
                    mark = np.zeros(len(found), bool)
                mark[end - n + 1 : end + 1] = True
                items.update(at)
        return mark, items


def spans(text: str, mark: np.ndarray) -> list[dict[str, int]]:
    """Code-point ranges of runs of hit words, from the first character of the run's first word to the last of its last."""
    data = text.encode()
    places = [m.span() for m in re.finditer(rb"[^ ]+", data.translate(_WORDS))]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mark.astype(np.int8), [0]])))
    out, at, chars = [], 0, 0
    for a, b in edge.reshape(-1, 2):
        start, stop = places[a][0], places[b - 1][1]
        first = chars + len(data[at:start].decode())
        at, chars = stop, first + len(data[start:stop].decode())
        out.append({"start": first, "end": chars})
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, share: int = 20, slice_bytes: int = 16 << 20) -> DataFrame:
    """docs with n_words, n_hit, hit_items (ids as strings, sorted), hit_spans and contaminated (n_hit > 0 and share * n_hit >= n_words)."""
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("name"), F.col(item_text_col).cast("string").alias("text")).filter("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_slices = max(1, -(-size // slice_bytes))
    names = [c for c in docs.columns if c not in (text_col, *RESULTS)]  # the text goes through the workers once
    state = docs.select(*names, F.lit(None).cast("binary").alias("_dc_bits"), F.array().cast("array<string>").alias("_dc_items"), F.col(text_col).cast("string").alias("_dc_text"))
    scratch = Scratch(spark, "decontaminate")
    for k in range(n_slices):
        picked = items.filter(F.pmod(F.xxhash64("text"), F.lit(n_slices)) == k) if n_slices > 1 else items
        shared = spark.sparkContext.broadcast(sorted((r["name"], r["text"]) for r in picked.collect()))
        state = _scan(state, names, shared, window, last=k == n_slices - 1)
        if k < n_slices - 1:
            state = scratch.keep(state, f"slice{k}")
    out = state.withColumn("hit_items", F.array_sort(F.array_distinct("_dc_items")))
    hit = (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))
    return out.withColumnRenamed("_dc_text", text_col).select(*(c for c in docs.columns if c not in RESULTS), "n_words", "n_hit", "hit_items", "hit_spans", hit.alias("contaminated"))


def _scan(state: DataFrame, names: list[str], shared, window: int, last: bool) -> DataFrame:
    n, name = len(names), uuid.uuid4().hex

    def run(batches):
        kept = held("windows")
        if name not in kept:
            kept.clear()
            kept[name] = Windows(shared.value, window)
        tool = kept[name]
        for batch in batches:
            for part in chunks(batch):
                bits, items, n_words, n_hit, places = [], [], [], [], []
                for text, before, old in zip(part.column("_dc_text").to_pylist(), part.column("_dc_bits").to_pylist(), part.column("_dc_items").to_pylist(), strict=True):
                    found = words(text) if text else []
                    mark, at = tool.hits(found)
                    if before is not None:
                        earlier = np.unpackbits(np.frombuffer(before, np.uint8), count=len(found)).astype(bool)
                        mark = earlier if mark is None else mark | earlier
                    n_words.append(len(found))
                    n_hit.append(0 if mark is None else int(mark.sum()))
                    items.append([*old, *(tool.names[i] for i in at)])
                    bits.append(None if mark is None or last else np.packbits(mark).tobytes())
                    places.append(spans(text, mark) if last and mark is not None else [])
                columns = [*part.columns[:n], pa.array(bits, pa.binary()), pa.array(items, pa.list_(pa.string())), part.column("_dc_text")]
                if last:
                    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                    columns += [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(places, kind)]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "_dc_bits", "_dc_items", "_dc_text", *(["n_words", "n_hit", "hit_spans"] if last else [])])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in state.schema.fields[:n])
    tail = ", n_words long, n_hit long, hit_spans array<struct<start: long, end: long>>" if last else ""
    return state.mapInArrow(run, f"{kinds}, _dc_bits binary, _dc_items array<string>, _dc_text string{tail}")
