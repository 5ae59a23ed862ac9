"""N-gram Jaccard join by PartEnum signatures, and the components of its links.

Texts become sets of k-word shingles. Sizes fall into bands such that linked sets lie in one band or
in neighbouring ones; within a band, a Jaccard bound is a bound on the number of differing shingles.
The shingle domain is partitioned (by hash) into groups of one or three cells. By the pigeonhole
principle some group of two linked sets differs in no shingle, or in at most one of three cells', so all
cells of one of the enumerated subsets are equal there: the pair shares that subset's signature.
Spare groups are added, so that a signature of nothing (subsets that are empty in a set) is needed only
by sets with more empty subsets than spare groups; so no link is lost, and empty cells make no hot keys.

Only sets that may have a link get signatures. Of a set's shingles in order of their hashes, those that remain without its
last ones, and some more (`least_shared`), are held against all other sets': linked sets share as many of these at least as
there are more, so sets that share fewer with all others together have no link.

Sets that share a signature aren't paired with each other. First every signature group compares its
members with one pivot. Groups that then still hold several components go on: of up to `LARGE`
members, four and then all others meet the members that aren't linked with them
yet; larger groups are cut into blocks, and pairs of blocks are compared by matrix products within a
task, which returns one edge per linked set. Of larger groups that overlap, a few come first, as the others are mostly
one component then, and of the others, those of one block, only members whose sketch allows a link are fetched. Pairs whose sketches differ in more bits than linked sets may in shingles are never fetched. Comparisons are exact, on whole texts; exact copies of a
set are compared once. Texts of a group never meet in one task beyond two blocks.

Defined results: null and empty texts, and texts without words, have size 0 and link with nothing; they are their own
component. Repeated rows and ids are sets of their own and get the component of their set. The
component's id is its smallest id; null ids are skipped there unless the row stands alone. Extra
columns are ignored. A set's identity is a 64-bit fingerprint of its shingles.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations
from math import exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orelode.llm.common import Scratch, workers
from orelode.llm.components import block_components, components
from orelode.llm.shingles import _PLACE, fingerprint, mix, shingle_sets
from orelode.llm.tokens import chunks, held

_U = np.uint64
#: Members from which a group is compared by blocks, and sets of a block.
LARGE, BLOCK = 40, 1200
#: Cells of a set's sketch.
SKETCH = 1024


def _times(place: int, n: int) -> np.uint64:
    """A multiplier times n, wrapped to 64 bits."""
    return _U(int(_PLACE[place]) * n & 0xFFFFFFFFFFFFFFFF)


@lru_cache(maxsize=8)
def bands(num: int, den: int, largest: int = 1 << 40) -> np.ndarray:
    """Largest size of each band: sizes a <= b <= a * den / num lie in one band or in neighbours."""
    tops = [1]
    while tops[-1] < largest:
        tops.append(max(tops[-1] + 1, tops[-1] * den // num))
    return np.array(tops)


@lru_cache(maxsize=100_000)
def plan(band: int, num: int, den: int) -> tuple[int, int, int, int]:
    """Groups of a band, how many of them are spare, cells of a group, and cells of a signature; no group where linked sets are equal.

    A pair differs in few shingles in short sets: one cell a group then. Spare groups are added until sets of the band's
    least size hardly ever have more groups with an empty subset than that (by trial, or by the Poisson tail for large sets).
    """
    top = int(bands(num, den)[band])
    differing = 2 * top * (den - num) // (den + num)
    # three cells where a differing shingle leaves enough equal ones beside it to make selective pairs of cells
    cells, chosen = (3, 2) if differing >= 12 and den + num >= 16 * (den - num) else (1, 1)
    if differing == 0:
        return 0, 0, cells, chosen
    need, size = -(-(differing + 1) // (cells - chosen + 1)), max(2, top * num // den * num // den)
    ways, spare = len(list(combinations(range(cells), chosen))), 1
    while spare < 3 * need + 8:
        n1 = need + spare
        mean = n1 * min(1.0, ways * exp(-size * chosen / cells / n1))
        if size > 300:
            if spare >= mean + 4 * sqrt(mean):
                break
        else:
            draws = np.random.default_rng(band).integers(0, n1 * cells, (2000, size)) + np.arange(2000)[:, None] * n1 * cells
            full = np.bincount(draws.ravel(), minlength=2000 * n1 * cells).reshape(2000, n1, cells)
            hollow = np.zeros((2000, n1), bool)
            for subset in combinations(range(cells), chosen):
                hollow |= full[:, :, subset].sum(2) == 0
            if (hollow.sum(1) > spare).mean() < 0.001:
                break
        spare += max(1, spare // 4)
    return need + spare, spare, cells, chosen


def signatures(found: np.ndarray, num: int, den: int) -> np.ndarray:
    """The signatures of a set (sorted distinct 64-bit hashes), as a member of its own band and as the smaller side of the next."""
    if not len(found):
        return np.empty(0, np.uint64)
    own = int(np.searchsorted(bands(num, den), len(found)))
    out = []
    content = mix(found ^ _PLACE[11])
    for band in (own, own + 1):
        n1, spare, cells, chosen = plan(band, num, den)
        if not n1:
            continue
        cell = (mix(found + _times(12, band)) >> _U(20)) % _U(n1 * cells)
        order = np.argsort(cell, kind="stable")
        at = cell[order].astype(np.int64)
        sums, sizes = np.zeros(n1 * cells, np.uint64), np.bincount(at, minlength=n1 * cells)
        starts = np.flatnonzero(np.diff(at, prepend=-1))
        sums[at[starts]] = np.add.reduceat(content[order], starts)
        sums, sizes = sums.reshape(n1, cells), sizes.reshape(n1, cells)
        subsets, counts = [], []
        for number, subset in enumerate(combinations(range(cells), chosen)):
            total = np.arange(n1, dtype=np.uint64) * _PLACE[14] + np.full(n1, _times(13, number + 1)) + np.full(n1, _times(15, band))
            for c in subset:
                total = mix(total + sums[:, c])
            subsets.append(total)
            counts.append(sizes[:, subset].sum(1))
        subsets, counts = np.array(subsets), np.array(counts)
        hollow = int((counts == 0).any(0).sum())
        out.append(subsets[counts > 0] if hollow <= spare else subsets.ravel())
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def least_shared(size, num: int, den: int):
    """Shingles of a set's least hashes, and how many of them it shares with any one set that it links with (a tenth of what linked sets share).

    A linked set has -(-size * num // den) of its shingles at least. All but that many less `few` of the set's own are its first ones; the rest
    can't hold more than that of the common ones, so `few` at least are among the first ones, and of both sets the same.
    """
    both = -(-size * num // den)
    few = -(-both // 10)
    return size - both + few, few


def row_key(doc_id: Column, text: Column) -> Column:
    """A number for equal rows: a null id isn't an empty one, and a null text isn't an empty text."""
    return F.xxhash64(F.lit(5), doc_id.isNull(), doc_id.cast("string"), text.isNull(), text.cast("string"))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_row (equal only for equal rows), doc_id, text."""
    text = F.col(text_col).cast("string")
    return docs.select(row_key(F.col(id_col), text).alias("_row"), F.col(id_col).alias("doc_id"), text.alias("text"))


def _sets(texts: DataFrame, k: int) -> DataFrame:
    def run(batches):
        held("sets")
        for batch in batches:
            for part in chunks(batch):
                sets = shingle_sets(part.column("text").to_pylist(), k)
                bits = pa.array([sketch(x) for x in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("_row"), part.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), pa.array([fingerprint(x) for x in sets], pa.int64()), bits], names=["_row", "doc_id", "n", "fp", "sketch"])

    return texts.mapInArrow(run, f"_row long, doc_id {texts.schema['doc_id'].dataType.simpleString()}, n long, fp long, sketch array<long>")


def sketch(found: np.ndarray) -> np.ndarray:
    """Parities of a set's shingles in SKETCH cells, 64 a number: two sets differ in as many shingles at least as their sketches in bits."""
    odd = np.bincount((found >> _U(40)).astype(np.int64) % SKETCH, minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _possible(pairs: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sketches don't rule a link out: sets of sizes s and t link only if they differ in (s + t) (den - num) / (den + num) shingles at most."""
    a, b = (sketches.select(F.col("fp").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab")
    apart = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    both = pairs.join(a, "a").join(b, "b").select("a", "b", apart.alias("apart"), (F.col("na") + F.col("nb")).alias("size"))
    return both.filter(F.col("apart") * (den + num) <= F.col("size") * (den - num)).select("a", "b")


def _first_rows(texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(sig, fp): of each set, the shingles of least hashes that it may share with linked sets."""

    def run(batches):
        held("sets")
        seen: set[int] = set()
        for batch in batches:
            for part in chunks(batch):
                fps, sizes, firsts = [], [], [np.empty(0, np.uint64)]
                if len(seen) > 500_000:
                    seen.clear()
                for found in shingle_sets(part.column(0).to_pylist(), k):
                    if len(found) and (fp := fingerprint(found)) not in seen:  # copies of a set within a task: once
                        seen.add(fp)
                        firsts.append(found[: least_shared(len(found), num, den)[0]])
                        fps.append(fp)
                        sizes.append(len(firsts[-1]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(firsts).view(np.int64)), pa.array(np.repeat(np.array(fps, np.int64), sizes))], names=["sig", "fp"])

    return texts.select("text").mapInArrow(run, "sig long, fp long")


def _signature_rows(sources: DataFrame, k: int, num: int, den: int) -> DataFrame:
    def run(batches):
        held("sets")
        for batch in batches:
            for part in chunks(batch):
                sigs = [signatures(found, num, den) for found in shingle_sets(part.column(1).to_pylist(), k)]
                fps = np.repeat(part.column(0).to_numpy(), [len(x) for x in sigs])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *sigs]).view(np.int64)), pa.array(fps)], names=["sig", "fp"])

    return sources.select("fp", "text").mapInArrow(run, "sig long, fp long")


def _met(rows: DataFrame) -> DataFrame:
    """The rows (sig, fp), each once, whose sig several sets have. A set has a sig once, so even one that all sets have is a small part
    of the rows; the window reads 16 bytes a row, spills, and holds no texts."""
    group = Window.partitionBy("sig")
    return rows.withColumns({"lo": F.min("fp").over(group), "hi": F.max("fp").over(group)}).filter("lo < hi").select("sig", "fp").distinct()


def _verified(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of fingerprints whose sets link; texts has a text per fingerprint."""
    left = pairs.join(texts.select(F.col("fp").alias("b"), F.col("text").alias("tb")), "b")
    full = left.join(texts.select(F.col("fp").alias("a"), F.col("text").alias("ta")), "a").sortWithinPartitions("a")

    def run(batches):
        held("sets")
        last, pivot = None, None
        for batch in batches:
            for part in chunks(batch.select(["a", "b", "ta", "tb"])):
                a, linked = part.column("a").to_pylist(), []
                for x, ta, found in zip(a, part.column("ta"), shingle_sets(part.column("tb").to_pylist(), k), strict=True):
                    if x != last:
                        last, pivot = x, shingle_sets([ta.as_py()], k)[0]
                    both = len(np.intersect1d(pivot, found, assume_unique=True)) if den * min(len(pivot), len(found)) >= num * max(len(pivot), len(found)) else 0
                    linked.append(den * both >= num * (len(pivot) + len(found) - both))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return full.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every a with every b: products of 0/1 matrices, some thousand elements at a time."""
    ea, eb = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(ea, eb)
    ra, rb = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    pa_, pb = np.searchsorted(both, ea), np.searchsorted(both, eb)
    ia, ib = (pa_ < len(both)) & (both[np.minimum(pa_, len(both) - 1)] == ea) if len(both) else np.zeros(len(ea), bool), (pb < len(both)) & (both[np.minimum(pb, len(both) - 1)] == eb) if len(both) else np.zeros(len(eb), bool)
    ra, rb, pa_, pb = ra[ia], rb[ib], pa_[ia], pb[ib]
    out = np.zeros((len(a), len(b)), np.float32)
    for lo in range(0, len(both), 4096):
        ka, kb = (pa_ >= lo) & (pa_ < lo + 4096), (pb >= lo) & (pb < lo + 4096)
        width = min(4096, len(both) - lo)
        ma, mb = np.zeros((len(a), width), np.float32), np.zeros((len(b), width), np.float32)
        ma[ra[ka], pa_[ka] - lo], mb[rb[kb], pb[kb] - lo] = 1, 1
        out += ma @ mb.T
    return out.astype(np.int64)


def _may_link(groups: DataFrame, sketches: DataFrame, partitions: int, num: int, den: int) -> DataFrame:
    """Rows (sig, fp, label, nb) of groups of one block whose sketch allows a link with a member of another label; the others need no texts."""
    dealt = groups.join(sketches.select("fp", "n", "sketch"), "fp").repartition(partitions, "sig").sortWithinPartitions("sig")

    def solve(sig, parts):
        fp, label, size = (np.concatenate([x[c] for x in parts]) for c in range(3))
        bits, keep = np.concatenate([x[3] for x in parts]), np.zeros(len(fp), bool)
        for lo in range(0, len(fp), 64):
            here = slice(lo, lo + 64)
            apart = np.bitwise_count(bits[here, None] ^ bits[None]).sum(2, dtype=np.int64)
            keep[here] = ((apart * (den + num) <= (size[here, None] + size) * (den - num)) & (label[here, None] != label)).any(1)
        return pa.RecordBatch.from_arrays([pa.array(np.full(int(keep.sum()), sig)), pa.array(fp[keep]), pa.array(label[keep]), pa.array(np.ones(int(keep.sum()), np.int32))], names=["sig", "fp", "label", "nb"])

    def run(batches):
        key, parts = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            sig, fp, label, size = (batch.column(c).to_numpy() for c in ("sig", "fp", "label", "n"))
            bits = batch.column("sketch").flatten().to_numpy().view(np.uint64).reshape(len(sig), -1)
            cuts = np.append(np.flatnonzero(np.append(True, sig[1:] != sig[:-1])), len(sig)).tolist()
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if parts and sig[lo] != key:
                    yield solve(key, parts)
                    parts = []
                key = sig[lo]
                parts.append((fp[lo:hi], label[lo:hi], size[lo:hi], bits[lo:hi]))
        if parts:
            yield solve(key, parts)

    return dealt.select("sig", "fp", "label", "n", "sketch").mapInArrow(run, "sig long, fp long, label long, nb int")


def _block_links(groups: DataFrame, texts: DataFrame, partitions: int, k: int, num: int, den: int) -> DataFrame:
    """Edges (a, b) that connect all linked sets of each large group; groups: sig, fp, label, nb (blocks of the group)."""
    mine = F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int")
    items = groups.select("sig", "fp", "label", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other"))
    items = items.select("sig", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), F.when(F.col("mine") <= F.col("other"), 0).otherwise(1).alias("side"), "fp", "label")
    dealt = items.join(texts, "fp").repartition(partitions, "sig", "i", "j").sortWithinPartitions("sig", "i", "j", "side", "fp")

    def solve(held, one_block):
        (ka, la, sa), (kb, lb, sb) = held[0], held[0] if one_block else held[1]
        ka, kb, la, lb = (np.array(x, np.int64) for x in (ka, kb, la, lb))
        if not len(ka) or not len(kb) or (la[0] == la).all() and (la[0] == lb).all():
            return None
        na, nb = np.array([len(x) for x in sa]), np.array([len(x) for x in sb])
        met = common(sa, sb)
        linked = (den * met >= num * (na[:, None] + nb[None, :] - met)) & (ka[:, None] != kb[None, :])
        nodes, labels = block_components(linked, ka, kb)
        # an edge for each two components that meet here, not for each set
        keys, before = np.concatenate([ka, kb]), np.concatenate([la, lb])
        order = np.argsort(keys, kind="stable")
        of = lambda x: before[order[np.searchsorted(keys, x, sorter=order)]]
        ends = np.stack([of(nodes), of(labels)], 1)
        _, first = np.unique(ends, axis=0, return_index=True)
        first = first[ends[first, 0] != ends[first, 1]]
        return pa.RecordBatch.from_arrays([pa.array(nodes[first]), pa.array(labels[first])], names=["a", "b"])

    def run(batches):
        item, held = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            for part in chunks(batch):
                sig, i, j, side = (part.column(c).to_pylist() for c in ("sig", "i", "j", "side"))
                sets = shingle_sets(part.column("text").to_pylist(), k)
                for n, (fp, label) in enumerate(zip(part.column("fp").to_pylist(), part.column("label").to_pylist(), strict=True)):
                    here = (sig[n], i[n], j[n])
                    if here != item:
                        if item is not None and (got := solve(held, item[1] == item[2])) is not None:
                            yield got
                        item, held = here, (([], [], []), ([], [], []))
                    for to, what in zip(held[side[n]], (fp, label, sets[n]), strict=True):
                        to.append(what)
        if item is not None and (got := solve(held, item[1] == item[2])) is not None:
            yield got

    return dealt.select("sig", "i", "j", "side", "fp", "label", "text").mapInArrow(run, "a long, b long")


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row, for links of den * |A & B| >= num * |A | B|; and _row, for joining back."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    texts = _texts(docs, id_col, text_col)
    sets = scratch.keep(_sets(texts, k), "sets")
    shared = scratch.keep(_met(_first_rows(texts, k, num, den)).groupBy("fp").agg(F.count(F.lit(1)).alias("shared")), "shared")
    scratch.release()
    both = F.expr(f"(n * {num} + {den - 1}) div {den}")
    likely = sets.filter("n > 0").join(shared, "fp").filter(F.col("shared") >= F.floor((both + 9) / 10))
    one = likely.groupBy("fp").agg(F.min(F.struct("_row", "n", "sketch")).alias("of")).select("fp", "of.*")
    sketches = scratch.keep(one, "sketches")
    sources = scratch.keep(texts.select("_row", "text").join(sketches.select("fp", "_row"), "_row").select("fp", "text"), "texts")
    scratch.drop("shared")
    scratch.release()
    rows = scratch.keep(_met(_signature_rows(sources, k, num, den)), "met")
    members = rows.select("fp").distinct()
    del shared, likely, one
    scratch.release()
    labels = scratch.keep(members.select(F.col("fp").alias("node"), F.col("fp").alias("label")), "labels0")
    tested = None
    todo = rows.withColumn("pivoted", F.lit(False))
    for n in range(1, 200):
        here = todo.filter("not pivoted").join(labels.select(F.col("node").alias("fp"), "label"), "fp")
        # groups of several components; of groups with the same members, one
        tag = lambda seed: F.bit_xor(F.xxhash64("fp", F.lit(seed))).alias(f"x{seed}")
        groups = here.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), tag(1), tag(2), F.count(F.lit(1)).alias("n")).filter("lo < hi")
        open_ = groups.groupBy("x1", "x2", "n").agg(F.min("sig").alias("sig")).select("sig")
        state = scratch.keep(here.join(open_, "sig").select("sig", "fp", "label"), f"state{n}")
        if not state.limit(1).count():
            break  # every group is one component, or all its members have met
        links, later = None, None
        if n == 1:  # one pivot a group: partial minima, no ranking
            pivots = state.groupBy("sig").agg(F.min(F.struct("fp", "label")).alias("p")).select("sig", F.col("p.fp").alias("pivot"), F.col("p.label").alias("pivot_label"))
        else:
            sizes = state.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LARGE).select("sig", F.ceil(F.col("n") / BLOCK).cast("int").alias("nb"))
            large = scratch.keep(state.join(sizes, "sig"), f"large{n}")
            if large.limit(1).count():
                small = scratch.keep(state.join(sizes, "sig", "left_anti"), f"small{n}")
                if n == 2:  # groups overlap: first those of which some member has no earlier one; then most others are one component
                    lead = scratch.keep(large.groupBy("fp").agg(F.min("sig").alias("sig")).select("sig").distinct(), f"lead{n}")
                    later = large.join(lead, "sig", "left_anti").select("sig", "fp", F.lit(False).alias("pivoted"))
                    large = large.join(lead, "sig")
                else:
                    large = scratch.keep(_may_link(large.filter("nb = 1"), sketches, workers(docs.sparkSession), num, den).unionByName(large.filter("nb > 1").select("sig", "fp", "label", "nb")), f"likely{n}")
                links = _block_links(large, sources, workers(docs.sparkSession), k, num, den)
                state = small
            rank = F.row_number().over(Window.partitionBy("sig").orderBy("fp"))  # of at most LARGE members
            pivots = state.withColumn("rank", rank).filter(F.col("rank") <= (4 if n == 2 else LARGE)).select("sig", F.col("fp").alias("pivot"), F.col("label").alias("pivot_label"))
        pairs = state.join(pivots, "sig").filter("label <> pivot_label").select(F.least("pivot", "fp").alias("a"), F.greatest("pivot", "fp").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = scratch.keep(_possible(pairs, sketches, num, den), f"pairs{n}")
        tested = pairs if tested is None else tested.union(pairs)
        found = _verified(pairs, sources, k, num, den)
        links = scratch.keep(found if links is None else found.union(links), f"links{n}")
        del found
        scratch.release()
        named = links.join(labels.select(F.col("node").alias("a"), F.col("label").alias("x")), "a").join(labels.select(F.col("node").alias("b"), F.col("label").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        merged = components(named, scratch, f"merge{n}").select(F.col("node").alias("label"), F.col("label").alias("new"))
        labels = scratch.keep(labels.join(merged, "label", "left").select("node", F.coalesce("new", "label").alias("label")), f"labels{n}")
        scratch.drop(f"state{n - 1}", f"links{n}", f"small{n - 1}", f"large{n - 1}", f"lead{n - 1}", f"likely{n - 1}", *(["met"] if n == 1 else []), f"labels{n - 1}")
        todo = state.join(pivots.select("sig", F.col("pivot").alias("fp"), F.lit(True).alias("was")), ["sig", "fp"], "left").select("sig", "fp", F.coalesce("was", F.lit(False)).alias("pivoted"))
        todo = todo if later is None else todo.unionByName(later)
    scratch.drop("texts", "sketches", *(f"pairs{i}" for i in range(1, n)), f"state{n - 1}", f"state{n}", *(f"{x}{n - 1}" for x in ("small", "large", "lead", "likely")))
    scratch.release()
    # component ids by fingerprint first: a fingerprint of very many copies is one row here
    least = sets.filter("n > 0").groupBy("fp").agg(F.min("doc_id").alias("least")).join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    named = least.join(least.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("fp", "component_id")
    linked = sets.filter("n > 0").join(named, "fp").select("_row", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return linked.unionByName(sets.filter("n = 0").select("_row", "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that of the least id (equal rows are one). Rows without words all stay."""
    found = jaccard_components(docs, k, num, den, id_col, text_col)
    stays = found.filter("n_shingles > 0").groupBy("component_id").agg(F.min_by("_row", F.struct("doc_id", "_row")).alias("_row")).select("_row", F.lit(True).alias("_stays"))
    bare = found.filter("n_shingles = 0").select("_row", F.lit(False).alias("_stays")).distinct()
    kept = docs.withColumn("_row", row_key(F.col(id_col), F.col(text_col))).join(stays.unionByName(bare), "_row")
    one = F.row_number().over(Window.partitionBy("_row").orderBy(F.lit(1)))
    return kept.withColumn("_n", one).filter("_n = 1 or not _stays").select(*docs.columns)
