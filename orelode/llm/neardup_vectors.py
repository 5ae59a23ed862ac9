"""Embedding near-dedup: spherical k-means cells, blocked cosine products in them, a representative per group.

Every vector has a home cell (the nearest centre) and visits each other cell in which a vector close
enough to link with it could be at home: with |x - y| <= r = sqrt(2 - 2 t) for linked unit vectors, y at
home in cell j needs x . (c_i - c_j) <= r |c_i - c_j|. A home vector therefore meets all its links in
its own cell, so counts and links are complete whatever the centres are; they only set the work.

Centres are fitted on at most `sample_rows` rows; all rows are assigned. How many centres are used is
the choice of least estimated work on that sample (one cell for vectors without clusters). Within a
cell, groups of home vectors (`block` to four times as many) meet parts of its members (four times a group's). A round deals
GROUPS groups of every cell and all members of those cells, and its shuffle files go before the next one, so the disk holds a few times
the vectors however many groups there are; the work is all groups against all parts. Linked pairs stay in the task, which gives a count
per home vector and one edge per linked vector to the least of its component in the group and the part. Products are taken in
single precision and, where that leaves a doubt, again in double. Equal vectors are one vector with a count.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with
nothing, and neither do vectors of different lengths. Repeated rows link with each other. Null ids are
skipped in the smallest id of a component. Extra columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelode.llm.common import Scratch, workers
from orelode.llm.components import block_components, components, edge_components


#: Rows of products with all centres that are held at once.
ROWS = 512
#: Groups of home vectors of a cell that a round deals, and vectors of either side whose products are held at once.
GROUPS, TILE = 1, 2048


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """k unit centres of unit vectors."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        home = np.concatenate([(x[i : i + ROWS] @ centres.T).argmax(1) for i in range(0, len(x), ROWS)])
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        norm = np.linalg.norm(sums, axis=1)
        live = norm > 1e-12
        centres[live] = sums[live] / norm[live, None]
        centres[~live] = x[rng.integers(0, len(x), int((~live).sum()))]
    return centres


def cells_of(x: np.ndarray, centres: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each unit vector, and a mark for each cell it is in (home or visit)."""
    apart = np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T))
    apart *= np.sqrt(2 - 2 * threshold) + 1e-6
    home, inside = np.empty(len(x), np.int64), np.empty((len(x), len(centres)), bool)
    for i in range(0, len(x), ROWS):
        dots = x[i : i + ROWS] @ centres.T
        at = home[i : i + ROWS] = dots.argmax(1)
        inside[i : i + ROWS] = dots[np.arange(len(dots)), at][:, None] - dots <= apart[at] + 1e-9
    return home, inside


def choose_centres(sample: np.ndarray, total: int, threshold: float) -> np.ndarray:
    """The centres of least estimated work over all rows: products in cells, and copies of visitors."""
    best, least = None, np.inf
    for k in (1, 4, 16, 64, 256, 1024):
        if k > max(1, len(sample) // 8):
            break
        centres = spherical_kmeans(sample, k)
        home, inside = cells_of(sample, centres, threshold)
        scale = total / len(sample)
        pairs = float(np.bincount(home, minlength=k) @ inside.sum(0)) * scale * scale
        work = pairs + 2000.0 * inside.sum() * scale
        if work < least:
            best, least = centres, work
    return best


def _values(column, dim: int) -> np.ndarray:
    """Rows of a column of lists of dim numbers."""
    return np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()).reshape(-1, dim)


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def tile_links(a: np.ndarray, b: np.ndarray, a32: np.ndarray, b32: np.ndarray, ka: np.ndarray, kb: np.ndarray, threshold: float) -> np.ndarray | None:
    """Which a link with which b (others by key), or None if none do; a32 and b32 are a and b in single precision."""
    doubt = 1.2e-7 * (a.shape[1] + 4)
    near = a32 @ b32.T
    i, j = np.nonzero(near >= np.float32(threshold - doubt))
    sure = near[i, j] >= threshold + doubt
    for lo in range(0, len(i), 100_000):
        some = lo + np.flatnonzero(~sure[lo : lo + 100_000])
        sure[some] = np.einsum("ij,ij->i", a[i[some]], b[j[some]]) >= threshold
    sure &= ka[i] != kb[j]
    if not sure.any():
        return None
    linked = np.zeros(near.shape, bool)
    linked[i[sure], j[sure]] = True
    return linked


def embedding_components(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", sample_rows: int = 20_000, block: int = 4096) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    v = F.col("v")
    single_precision = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<float>" if single_precision else "array<double>").alias("v"))
    sound = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("key", F.when(sound, F.xxhash64(F.transform(v, lambda x: x + 0.0)))).withColumn("dim", F.size("v"))
    named = rows.select("vec_id", "key")
    single = scratch.keep(rows.filter("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("w"), F.min("vec_id").alias("least"), F.first("v").alias("v"), F.first("dim").alias("dim")), "distinct")
    found = []
    for dim, total in sorted(tuple(r) for r in single.groupBy("dim").count().collect()):  # vectors of one length at a time
        found.append(_cell_links(single.filter(F.col("dim") == dim), dim, total, scratch, threshold, sample_rows, block))
    if not found:
        return named.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    links = found[0]
    for x in found[1:]:
        links = links.unionByName(x)
    counts = links.filter("links is not null").groupBy("key").agg(F.sum("links").alias("links"))
    labels = components(links.filter("links is null").select(F.col("key").alias("a"), F.col("other").alias("b")), scratch, "labels")
    whole = single.select("key", "w", "least").join(counts, "key", "left").join(labels.withColumnRenamed("node", "key"), "key", "left").select("key", "least", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("label", "key").alias("label"))
    told = whole.join(whole.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("key", "n_links", "component_id")
    out = named.join(told, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _cell_links(single: DataFrame, dim: int, total: int, scratch: Scratch, threshold: float, sample_rows: int, block: int) -> DataFrame:
    """(key, links, null) counts and (key, null, other) edges of the distinct vectors of one length."""
    spark = single.sparkSession
    name = uuid.uuid4().hex
    share = min(1.0, sample_rows / total)
    picked = single.filter(F.pmod("key", F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("key", "v").limit(sample_rows).toArrow().sort_by("key")
    centres = choose_centres(_unit(_values(picked.column("v"), dim)), total, threshold)
    kind = np.float32 if single.schema["v"].dataType.simpleString() == "array<float>" else np.float64
    shared = spark.sparkContext.broadcast(centres)

    def assign(batches):
        centres = shared.value
        for batch in batches:
            x = _values(batch.column("v"), dim)
            home, inside = cells_of(_unit(x), centres, threshold)
            at, cell = np.nonzero(inside)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(cell == home[at]), batch.column("key").take(pa.array(at)), batch.column("w").take(pa.array(at)), pa.array([r.tobytes() for r in x[at]], pa.binary())], names=["cell", "home", "key", "w", "x"])

    members = scratch.keep(single.select("key", "w", "v").mapInArrow(assign, "cell int, home boolean, key long, w long, x binary"), f"cells-{name}", codec="lz4")
    group = max(1, min(4 * block, max(block, total // 16), (64 << 20) // (12 * dim)))
    # a row per cell: how many groups its home vectors and how many parts its members make
    sizes = members.groupBy("cell").agg(F.greatest(F.lit(1), F.ceil(F.count_if("home") / group)).cast("int").alias("nh"), F.ceil(F.count(F.lit(1)) / (4 * group)).cast("int").alias("nm"))
    sizes = scratch.keep(sizes, f"sizes-{name}")
    sized = members.join(F.broadcast(sizes), "cell")  # at most as many rows as there are centres
    own = F.pmod(F.xxhash64("key"), F.col("nh")).cast("int")
    other = F.pmod(F.xxhash64("key", F.lit(1)), F.col("nm")).cast("int")

    def dealt(lo: int) -> DataFrame:
        here = sized.filter(F.col("nh") > lo)
        last = F.least(F.col("nh"), F.lit(lo + GROUPS)) - 1
        left = here.filter("home").withColumn("i", own).filter(F.col("i").between(lo, lo + GROUPS - 1)).select("cell", "i", F.explode(F.sequence(F.lit(0), F.col("nm") - 1)).alias("j"), F.lit(0).alias("side"), "key", "w", "x")
        right = here.select("cell", F.explode(F.sequence(F.lit(lo), last)).alias("i"), other.alias("j"), F.lit(1).alias("side"), "key", "w", "x")
        return left.unionByName(right).repartition(workers(spark), "cell", "i", "j").sortWithinPartitions("cell", "i", "j", "side")

    def products(batches):
        item, held, a = None, [], None

        def meet(kb, wb, xb):
            nonlocal a
            if a is None:
                ka, xa = (np.concatenate([x[c] for x in held]) for c in range(2))
                xa = _unit(xa)
                a = ka, xa, xa.astype(np.float32), np.zeros(len(ka), np.int64), []
            ka, xa, xa32, counts, edges = a
            for v in range(0, len(kb), TILE):
                kv, xv = kb[v : v + TILE], _unit(xb[v : v + TILE])
                xv32 = xv.astype(np.float32)
                for u in range(0, len(ka), TILE):
                    ku = ka[u : u + TILE]
                    linked = tile_links(xa[u : u + TILE], xv, xa32[u : u + TILE], xv32, ku, kv, threshold)
                    if linked is not None:
                        counts[u : u + TILE] += linked @ wb[v : v + TILE]
                        edges.append(block_components(linked, ku, kv))

        def told():
            if a is None or not a[4]:
                return
            ka, counts = a[0], a[3]
            nodes, least = edge_components(*(np.concatenate([x[c] for x in a[4]]) for c in range(2)))
            some, moved = counts > 0, nodes != least
            n, m = int(some.sum()), int(moved.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ka[some], nodes[moved]])), pa.array([*counts[some].tolist(), *[None] * m], pa.int64()), pa.array([*[None] * n, *least[moved].tolist()], pa.int64())], names=["key", "links", "other"])

        for batch in batches:
            if not batch.num_rows:
                continue
            c, i, j, side = (batch.column(x).to_numpy() for x in ("cell", "i", "j", "side"))
            cuts = np.flatnonzero((np.diff(c) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0) | (np.diff(side) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(c)], strict=True):
                here = (c[lo], i[lo], j[lo])
                if here != item:
                    yield from told()
                    item, held, a = here, [], None
                part = batch.slice(lo, hi - lo)
                x = np.frombuffer(b"".join(part.column("x").to_pylist()), kind).reshape(-1, dim)
                if side[lo] == 0:
                    held.append((part.column("key").to_numpy(), x))
                elif held:  # the home vectors come first
                    meet(part.column("key").to_numpy(), part.column("w").to_numpy(), x)
        yield from told()

    for lo in range(0, sizes.agg(F.max("nh")).first()[0], GROUPS):
        links = scratch.keep(dealt(lo).mapInArrow(products, "key long, links long, other long"), f"links-{name}", append=True)
        scratch.release()
    scratch.drop(f"cells-{name}")
    return links
