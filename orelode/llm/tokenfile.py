"""Token files: frequency-ranked ids, byte-aligned variable-length codes, control bytes apart.

A file set has the rank table and blocks of whole documents in ascending order of id. In a block,
`control` holds two bits an id (bytes of its code less one, four ids a byte, first id lowest) and
`data` the little-endian codes; the code of an id is its rank by frequency over the whole corpus, so
frequent ids take one byte. numpy decodes by table lookup: a control byte gives four lengths at once.
The container is Parquet in the shared folder (or the given path), so Spark's writer commits files
whole and any store that Spark reads can hold them.

Defined results: null and empty texts hold the end id only. Rows with equal ids stay apart, in the
order of their texts; null ids come first. Extra columns are ignored. An empty table makes an empty
file set.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.llm.common import Scratch, workers
from orelode.llm.tokens import chunks, encoder, held, vocabulary_size

#: Lengths of the four codes that each control byte stands for, and their sum.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1).astype(np.uint8)


def encode_codes(codes: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit codes."""
    width = 2 if not len(codes) or codes.max() <= 0xFFFF else 4  # bytes of the longest codes: fewer to look at
    codes = codes.astype(f"<u{width}")
    keep = np.ones((len(codes), width), bool)
    for k in range(1, width):
        keep[:, k] = codes >> np.uint8(8 * k) > 0
        keep[:, 1:k] |= keep[:, k : k + 1]
    padded = np.zeros(-(-len(codes) // 4) * 4, np.uint8)
    padded[: len(codes)] = keep[:, 1:].sum(1, dtype=np.uint8) if width > 2 else keep[:, 1]
    a, b, c, d = padded.reshape(-1, 4).T
    return (a | b << 2 | c << 4 | d << 6).tobytes(), codes.view(np.uint8).reshape(-1, width)[keep].tobytes()


def decode_codes(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n codes again."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    start = np.cumsum(size, dtype=np.int64) - size
    raw = np.frombuffer(data, np.uint8)
    out = raw[start].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(size > k)
        if not len(longer):
            break
        out[longer] |= raw[start[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def write_tokens(docs: DataFrame, vocab: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, block_ids: int = 200_000) -> str:
    """Write the file set and return its folder. A block ends with the document that takes it over block_ids ids.

    Two passes: ids in document order (range partitions), which also counts every id; then codes,
    block by block. The driver gets a count per id of the vocabulary and a total per partition.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    path = path or f"{scratch.base}/files"
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    id_type = pa.from_numpy_dtype(np.int64) if kind == "bigint" else None
    wide = vocabulary_size(vocab) > 1 << 16
    raw_type = np.dtype("<u4" if wide else "<u2")  # of ids between the passes
    end = np.array([end_id], raw_type).tobytes()

    def cut(batches):
        """Blocks of raw ids with their place in the partition; docs that end a block, and counts of ids in the last row."""
        tool, part_no, start, block = encoder(vocab, raw_type.str), TaskContext.get().partitionId(), 0, 0
        counts = np.zeros(1, np.int64)
        held_ids, held_docs, held_n, size = [], [], [], 0

        def row(tally=None):
            nonlocal start, block, held_ids, held_docs, held_n, size
            out = pa.RecordBatch.from_arrays(
                [pa.array([part_no], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()), pa.array([held_docs], pa.list_(id_type) if id_type else None), pa.array([held_n], pa.list_(pa.int64())), pa.array([b"".join(held_ids)], pa.binary()), pa.array([tally], pa.binary())],
                names=["part", "block", "start", "docs", "n_tokens", "ids", "tally"],
            )
            start, block = start + size, block + 1
            held_ids, held_docs, held_n, size = [], [], [], 0
            return out

        for batch in batches:
            for piece in chunks(batch):
                got = tool.encode(piece.column(1).to_pylist())
                seen = np.bincount(np.frombuffer(b"".join([*got, end * len(got)]), raw_type))
                if len(seen) > len(counts):
                    counts = np.pad(counts, (0, len(seen) - len(counts)))
                counts[: len(seen)] += seen
                for doc, ids in zip(piece.column(0).to_pylist(), got, strict=True):
                    held_ids += [ids, end]
                    held_docs.append(doc)
                    held_n.append(len(ids) // raw_type.itemsize + 1)
                    size += held_n[-1]
                    if size >= block_ids:
                        yield row()
        if block or size:
            yield row(counts.astype("<i8").tobytes())

    shape = f"part int, block int, start long, docs array<{kind}>, n_tokens array<bigint>, ids binary, tally binary"
    ordered = source.repartitionByRange(workers(spark), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    raw = scratch.keep(ordered.mapInArrow(cut, shape), "raw", codec="lz4", dictionary=False)

    def tallies(batches):
        total = np.zeros(1, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                seen = np.frombuffer(x, "<i8")
                total = np.pad(total, (0, max(0, len(seen) - len(total))))
                total[: len(seen)] += seen
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["id", "n"])

    ids = raw.filter("tally is not null").select("tally").mapInArrow(tallies, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    by_rank = np.array([r["id"] for r in sorted(ids, key=lambda r: (-r["n"], r["id"]))], np.int64)
    spark.createDataFrame([(i, int(x)) for i, x in enumerate(by_rank)], "rank int, id int").coalesce(1).write.parquet(f"{path}/ranks")
    rank = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, np.uint32)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    first, total = {}, 0
    for r in sorted(raw.groupBy("part").agg(F.max(F.col("start") + F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).collect()):
        first[r["part"]], total = total, total + r["n"]
    shared = spark.sparkContext.broadcast((rank, first))

    def code(batches):
        held("codes")  # the encoder of the pass before goes
        rank, first = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                control, data = encode_codes(rank[np.frombuffer(one.column("ids")[0].as_py(), raw_type)])
                start = first[one.column("part")[0].as_py()] + one.column("start")[0].as_py()
                yield pa.RecordBatch.from_arrays([one.column("part"), one.column("block"), pa.array([start], pa.int64()), one.column("docs"), one.column("n_tokens"), pa.array([control], pa.binary()), pa.array([data], pa.binary())], names=["part", "block", "start", "docs", "n_tokens", "control", "data"])

    coded = raw.drop("tally").mapInArrow(code, f"part int, block int, start long, docs array<{kind}>, n_tokens array<bigint>, control binary, data binary")
    coded.write.option("compression", "snappy").option("parquet.enable.dictionary", "false").parquet(f"{path}/blocks")
    scratch.drop("raw")
    return path


def read_tokens(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit) of each document of a file set; with digest, ids_crc32 instead of ids."""
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["docs"].dataType.elementType.simpleString()
    table = {r["rank"]: r["id"] for r in spark.read.parquet(f"{path}/ranks").collect()}  # as many as the vocabulary has ids
    by_rank = np.array([table[i] for i in range(len(table))], "<u4")
    shared = spark.sparkContext.broadcast(by_rank)

    def decode(batches):
        held("codes")
        by_rank = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                docs, sizes = one.column("docs").flatten(), one.column("n_tokens").flatten().to_numpy()
                ids = memoryview(by_rank[decode_codes(one.column("control")[0].as_py(), one.column("data")[0].as_py(), int(sizes.sum()))].tobytes())
                ends = np.cumsum(sizes)
                starts = ends - sizes
                each = [ids[4 * a : 4 * b] for a, b in zip(starts, ends, strict=True)]
                last = pa.array([zlib.crc32(x) for x in each], pa.int64()) if digest else pa.array([bytes(x) for x in each], pa.binary())
                yield pa.RecordBatch.from_arrays([docs, pa.array(starts + one.column("start")[0].as_py()), pa.array(sizes), last], names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    return blocks.select("start", "docs", "n_tokens", "control", "data").mapInArrow(decode, f"doc_id {kind}, start long, n_tokens long, {'ids_crc32 long' if digest else 'ids binary'}")
