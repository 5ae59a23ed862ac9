"""Best-fit packing with certified bounds.

Texts become token pieces of at most `capacity` (only longer ones are cut, the short piece first).
Full pieces are sequences of their own. The others are dealt by hash into partitions of about
`group` pieces; each is packed best fit decreasing, and dual feasible functions give a lower bound
on its sequences. A partition that meets its bound is certified, and only its emptiest sequence
stays open; of one with a gap a quarter of the sequences, the emptiest, stays open, as far as they hold the
partition's share of a later one. Open pieces of many partitions meet in fewer ones and are packed again, until one
partition is left; no partition of any round has more than about `group` pieces. `bound` certifies the whole. Every round is
written to the shared folder, so sequence numbers are settled once.

Defined results: a null text is an empty one: its piece holds the end id only. Repeated rows are
packed one by one, and null ids stay null. Extra columns are ignored. An empty table gives no piece.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelode.llm.common import Scratch
from orelode.llm.tokens import chunks, encoder

_PIECE = "doc_id {id}, piece int, start long, length long, ids_crc32 long"


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Sequences that any packing of pieces of these lengths needs."""
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1), capacity)


def bound_of_counts(count: np.ndarray, capacity: int) -> int:
    """Sequences that any packing of count[n] pieces of each length n needs: the best of the volume bound and the dual feasible functions below.

    u(x) at a threshold e: items over capacity - e count whole, those under e nothing, the rest by
    length. phi(x) for k = 2..: floor((k + 1) x / capacity) / k, left as x / capacity where exact.
    """
    if not count.any():
        return 0
    x = np.arange(capacity + 1)
    best = -(-int(count @ x) // capacity)
    suffix_n, prefix_v = np.cumsum(count[::-1])[::-1], np.concatenate([[0], np.cumsum(count * x)])
    for e in range(1, capacity // 2 + 1):
        whole = int(suffix_n[capacity - e + 1])
        volume = int(prefix_v[capacity - e + 1] - prefix_v[e])
        best = max(best, whole + -(-volume // capacity))
    for k in range(2, 12):
        exact = (k + 1) * x % capacity == 0
        value = np.where(exact, x * k, (k + 1) * x // capacity * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -(-int(count @ value) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item (which come in decreasing length), and each bin's fill.

    Bins are stacked by the room they have left; one big integer has a bit for each room that some bin has, so
    the tightest fitting bin is the lowest set bit at or above the length.
    """
    bins, offsets, fill = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for i, n in enumerate(lengths.tolist()):
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        by_room[room - n].append(b)
        rooms |= 1 << (room - n)
    return bins, offsets, np.array(fill, np.int64)


def pieces(docs: DataFrame, vocab: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """A row per piece of each text's ids and the end id: doc_id, piece, start, length, ids_crc32, and sequence_id of full pieces."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        tool, task, full = encoder(vocab), TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in chunks(batch):
                rows = []
                for row, ids in enumerate(tool.encode(part.column(1).to_pylist())):
                    ids += end
                    n, start, piece = len(ids) // 4, 0, 0
                    while start < n:
                        stop = start + ((n - start) % capacity or capacity)
                        length, seq = stop - start, None
                        if length == capacity:
                            seq, full = task << 32 | full, full + 1
                        rows.append((row, piece, start, length, zlib.crc32(ids[4 * start : 4 * stop]), seq))
                        start, piece = stop, piece + 1
                at, *rest = zip(*rows, strict=True)
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), *(pa.array(x, t) for x, t in zip(rest, kinds, strict=True))], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id"])

    return source.mapInArrow(run, _PIECE.format(id=kind) + ", sequence_id long")


def _pack(open_pieces: DataFrame, round_no: int, capacity: int, share: int) -> DataFrame:
    """Each partition packed on its own: sequence_id, offset, and settled (false: the piece goes to the next round).

    share: about as many pieces of a partition may stay open; none in the last round.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches):
        got = [b.select(names) for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        # a total order, so that a task run again packs alike
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = table.column("length").to_numpy()
        bins, offsets, fill = best_fit_decreasing(lengths, capacity)
        gap = len(fill) - lower_bound(lengths, capacity)
        emptiest = np.argsort(fill, kind="stable")
        within = int(np.searchsorted(np.cumsum(np.bincount(bins)[emptiest]), share, "right"))
        reopened = max(1, min(len(fill) // 4, within) if gap else 1) if share else 0
        settled = np.ones(len(fill), bool)
        settled[emptiest[:reopened]] = False
        seq = (round_no << 56 | TaskContext.get().partitionId() << 32) + bins
        out = table.append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(offsets)).append_column("settled", pa.array(settled[bins]))
        yield from out.to_batches(max_chunksize=20_000)

    kind = open_pieces.schema["doc_id"].dataType.simpleString()
    return open_pieces.select(*names).mapInArrow(run, _PIECE.format(id=kind) + ", sequence_id long, offset long, settled boolean")


def best_fit_packing(docs: DataFrame, vocab: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", group: int = 60_000, meet: int = 32) -> DataFrame:
    """Pieces with sequence_id and offset. group: pieces of a partition; meet: partitions whose open pieces meet in one.

    A partition's pieces are a few numbers each, so a partition takes a few MB whatever the texts hold.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    cut = scratch.keep(pieces(docs, vocab, capacity, id_col, text_col), "pieces")
    done = [cut.filter("sequence_id is not null").withColumn("offset", F.lit(0).cast("long"))]
    todo = cut.filter("sequence_id is null")
    parts = max(1, -(-todo.count() // group))
    for round_no in range(1, 64):
        last = parts == 1
        # dealt by content, so alike at every run; a new salt each round, so that other pieces meet
        dealt = todo.repartition(parts, F.xxhash64(F.lit(round_no), "doc_id", "piece", "start", "ids_crc32"))
        packed = scratch.keep(_pack(dealt, round_no, capacity, 0 if last else group // meet), f"round{round_no}")
        done.append(packed.filter("settled").select(*done[0].columns))
        if last:
            break
        todo, parts = packed.filter("not settled"), -(-parts // meet)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def bound(packed: DataFrame, capacity: int = 2048) -> int:
    """Sequences that any packing of these pieces needs; a count per length, at most `capacity`, comes to the driver."""
    count = np.zeros(capacity + 1, np.int64)
    for r in packed.groupBy("length").count().collect():
        count[r["length"]] = r["count"]
    return bound_of_counts(count, capacity)
