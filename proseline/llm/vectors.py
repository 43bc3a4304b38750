"""Embedding near-duplicates with an inverted multi-index.

Unit vectors are cut in halves, each half with a codebook of its own (k-means on a bounded sample: ``SAMPLE`` vectors, or 8 for each codeword); the product of the
codebooks is a grid of cells. Every vector is stored in the cell of its nearest codewords and, as a query, visits the
cells nearest to it in the order of the summed distances (multi-sequence traversal: of the sorted codewords i and j only
pairs with (i+1)(j+1) <= T can be among the first T). How many cells are visited is set by recall, which is always measured, in two
ways: a sample of queries is compared with all vectors, and T cells must find ``RECALL`` of their true links; and for each
of the queries a copy is planted at exactly the threshold's cosine in a random direction, the hardest link there is, of which T cells must find
``PLANTED`` (duplicates may be too rare for a sample to meet any). ``measured_recall`` is the smaller of the two shares that T reaches.
A pair is met if either of its vectors visits the other's cell, so more is found than is measured.
Candidates are verified by cosine in double precision.

Scale. Equal vectors are reduced to one with a count. The codebooks grow with the square root of the number of vectors (to at most
``MAX_CODEWORDS``, reached at 2 billion), so cells keep their size. A cell's stored and visiting vectors are dealt into blocks of about ``CHUNK`` each, so a hot cell is many
tasks' work; a block is one matrix product that hands over link counts and a spanning set of links, never all pairs.
Counting the links of a dense group takes all its comparisons (in blocks); nothing of that is emitted.

Defined results: null vectors, zero vectors and those with null or non-finite components have no links and stand alone. Vectors of
different lengths never link; each of the ``MAX_DIMS`` commonest lengths has an index of its own, and vectors of any
other length are compared with all of their length, in blocks. Repeated rows are vectors of their own. A null id
gives a null component and is kept. measured_recall is 1 where no index was needed. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Held, Scratch, components, table

THRESHOLD, RECALL, PLANTED = 0.95, 0.999, 0.95
SAMPLE, QUERIES, CHUNK = 20_000, 256, 512
MAX_CODEWORDS, MAX_DIMS, LEAST_CELLS = 16_384, 16, 4


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3, find=None) -> np.ndarray:
    """find: what gives each row's centre, if not nearest."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = (find or nearest)(x, centres)
        n = np.bincount(own, minlength=len(centres))
        sums = np.stack([np.bincount(own, x[:, d], len(centres)) for d in range(x.shape[1])], 1)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
        if (n == 0).any():
            centres[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return centres


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, a slice of rows at a time."""
    step = max(1, 4_000_000 // max(1, len(centres)))
    return np.concatenate([np.zeros(0, np.int64), *[squared(x[a : a + step], centres).argmin(1) for a in range(0, len(x), step)]])


def codewords(n: int) -> int:
    """How many each half has, for n vectors."""
    return int(np.clip(round(np.sqrt(n / 8)), 2, MAX_CODEWORDS))


def cells_before(near: np.ndarray, far: np.ndarray, total: float) -> int:
    """How many cells have a smaller sum of distances. far: sorted."""
    return int(np.searchsorted(far, (total - 1e-12) - near, side="left").sum())


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled first, so that tiny and huge ones keep their direction."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class MultiIndex:
    def __init__(self, sample: np.ndarray, n: int):
        k = codewords(n)
        self.half = max(1, sample.shape[1] // 2)
        self.books = [kmeans(sample[:, : self.half], k), kmeans(sample[:, self.half :], k)] if sample.shape[1] > 1 else [kmeans(sample, k), np.zeros((1, 0))]
        self.width = len(self.books[1])

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return squared(x[:, : self.half], self.books[0]), squared(x[:, self.half :], self.books[1])

    def visit(self, x: np.ndarray, t: int) -> np.ndarray:
        """The first t cells of each row's traversal (fewer columns if there are fewer cells); the first is its own."""
        t = min(t, len(self.books[0]) * self.width)
        if len(x) > 1024:
            return np.concatenate([self.visit(x[at : at + 1024], t) for at in range(0, len(x), 1024)])
        near, far = [], []
        for d in self.distances(x):
            k = min(t, d.shape[1])
            some = np.argpartition(d, k - 1, axis=1)[:, :k] if k < d.shape[1] else np.tile(np.arange(k), (len(x), 1))
            order = np.argsort(np.take_along_axis(d, some, 1), axis=1, kind="stable")
            near.append(np.take_along_axis(some, order, 1))
            far.append(np.take_along_axis(d, near[-1], 1))
        pairs = [(i, j) for i in range(near[0].shape[1]) for j in range(min(near[1].shape[1], t // (i + 1)))]
        i, j = (np.array(p) for p in zip(*pairs, strict=True))
        total = far[0][:, i] + far[1][:, j]
        best = np.argsort(total, axis=1, kind="stable")[:, :t]
        return np.take_along_axis(near[0][:, i] * self.width + near[1][:, j], best, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return unit(flat.reshape(len(column), -1)) if len(column) else np.zeros((0, 0))


def planted_ranks(index: MultiIndex, x: np.ndarray, threshold: float, seed: int = 7) -> np.ndarray:
    """For a copy of each row at the threshold's cosine, how many cells lie nearer to it than the row's own."""
    r = np.random.default_rng(seed).normal(size=x.shape)
    r -= (r * x).sum(1, keepdims=True) * x
    size = np.sqrt((r * r).sum(1, keepdims=True))
    y = np.where(size > 0, threshold * x + np.sqrt(max(0.0, 1 - threshold * threshold)) * r / np.where(size > 0, size, 1), x)
    own, d = index.visit(x, 1)[:, 0], index.distances(y)
    return np.array([cells_before(d[0][k], np.sort(d[1][k]), d[0][k][c // index.width] + d[1][k][c % index.width]) for k, c in enumerate(own)])


def _cells_needed(reps: DataFrame, index: MultiIndex, queries: np.ndarray, ids: list, threshold: float, recall: float) -> tuple[int, float]:
    """How many cells to visit, and the recall measured with so many."""
    held = Held(reps.sparkSession, (index, queries, ids))

    def run(batches):
        index, queries, ids = held.value
        d = index.distances(queries)
        far = np.sort(d[1], axis=1)
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column(1))
            q, y = np.nonzero(queries @ x.T >= threshold)
            own = np.array(batch.column(0).to_pylist(), object)
            other = np.array([ids[a] != own[b] for a, b in zip(q, y, strict=True)], bool)
            q, cell = q[other], index.visit(x, 1)[y[other], 0]
            if len(q):
                kinds, n = np.unique(np.stack([q, cell]), axis=1, return_counts=True)
                ranks = [cells_before(d[0][a], far[a], d[0][a][c // index.width] + d[1][a][c % index.width]) for a, c in kinds.T]
                yield pa.RecordBatch.from_arrays([pa.array(ranks, pa.int64()), pa.array(n, pa.int64())], ["rank", "n"])

    found = reps.select("rep", "embedding").mapInArrow(run, "rank long, n long").groupBy("rank").agg(F.sum("n").alias("n")).orderBy("rank").collect()
    real = np.repeat([r["rank"] for r in found], [r["n"] for r in found]) if found else np.zeros(0, np.int64)
    hard = planted_ranks(index, queries, threshold)
    t = LEAST_CELLS
    for ranks, share in ((real, recall), (hard, min(PLANTED, recall))):
        if len(ranks):
            t = max(t, int(np.sort(ranks)[int(np.ceil(share * len(ranks))) - 1]) + 1)
    return t, float(min((ranks < t).mean() for ranks in (real, hard) if len(ranks)))


def _block(key, batch: pa.Table, threshold: float) -> pa.Table:
    """Links of one block: rows (a, null, n) add n links to a; rows (a, b, null) are links that span the block's groups."""
    none = pa.table({"a": pa.array([], batch.schema.field("rep").type), "b": pa.array([], batch.schema.field("rep").type), "n": pa.array([], pa.int64())})
    asks = batch.column("asks").to_numpy().astype(bool)
    if asks.all() or not asks.any():
        return none
    ids = batch.column("rep").to_numpy()
    x = _matrix(batch.column("embedding"))
    n, own = batch.column("n").to_numpy(), batch.column("own").to_numpy()
    probes = batch.column("probes").combine_chunks()
    probes = probes.flatten().to_numpy().reshape(len(batch), -1)
    q, s = np.flatnonzero(asks), np.flatnonzero(~asks)
    linked = (x[q] @ x[s].T >= threshold) & (ids[q][:, None] != ids[s])
    a, b = np.nonzero(linked)
    if not len(a):
        return none
    count = np.zeros(len(batch), np.int64)
    np.add.at(count, q[a], n[s[b]])
    # a stored vector that does not itself visit the asking one's cell meets it only here
    cells, which = np.unique(own[q], return_inverse=True)
    meets = np.stack([(probes[s] == c).any(1) for c in cells])
    once = ~meets[which[a], b]
    np.add.at(count, s[b[once]], n[q[a[once]]])
    label = ids.copy()
    while True:  # the smallest id that links inside the block reach
        before = label.copy()
        np.minimum.at(label, q[a], label[s[b]])
        np.minimum.at(label, s[b], label[q[a]])
        if (before == label).all():
            break
    counted, tied = np.flatnonzero(count), np.flatnonzero(label != ids)
    kind = batch.schema.field("rep").type
    return pa.table({
        "a": pa.array(np.concatenate([ids[counted], ids[tied]]), kind),
        "b": pa.concat_arrays([pa.nulls(len(counted), kind), pa.array(label[tied], kind)]),
        "n": pa.concat_arrays([pa.array(count[counted], pa.int64()), pa.nulls(len(tied), pa.int64())]),
    })


def _links(reps: DataFrame, n: int, threshold: float, recall: float, scratch: Scratch) -> tuple[DataFrame, float]:
    """Links of reps (rep, n, embedding), all of one length, and the recall measured."""
    spark = reps.sparkSession
    sample = reps.withColumn("h", F.xxhash64("rep")).orderBy("h", "rep").limit(max(SAMPLE, 8 * codewords(n))).select("rep", "embedding").toArrow()
    x, ids = _matrix(sample.column("embedding")), sample.column("rep").to_pylist()
    index = MultiIndex(x, n)
    t, measured = _cells_needed(reps, index, x[:QUERIES], ids[:QUERIES], threshold, recall)
    held = Held(spark, index)

    def place(batches):
        for batch in batches:
            cells = held.value.visit(_matrix(batch.column(2)), t).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, cells.size + 1, cells.shape[1]), pa.int32()), pa.array(cells.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells[:, 0]), lists], [*batch.schema.names, "own", "probes"])

    kind = reps.schema["rep"].dataType.simpleString()
    spots = scratch.save(reps.select("rep", "n", "embedding").mapInArrow(place, f"rep {kind}, n long, embedding {reps.schema['embedding'].dataType.simpleString()}, own long, probes array<long>"))
    return _compare(spots, threshold, scratch), measured


def _compare(spots: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """Links between vectors (rep, n, embedding) and those whose own cell is among the cells that they probe."""
    kind = spots.schema["rep"].dataType.simpleString()
    stored = spots.select("*", F.col("own").alias("cell"), F.lit(False).alias("asks"))
    asking = spots.select("*", F.explode("probes").alias("cell"), F.lit(True).alias("asks"))
    chunks = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / CHUNK)).cast("int")
    load = spots.groupBy("own").agg(F.count("*").alias("ns")).join(asking.groupBy("cell").agg(F.count("*").alias("nq")), F.col("own") == F.col("cell"))
    load = scratch.save(load.select("cell", chunks("ns").alias("ks"), chunks("nq").alias("kq")))
    both = stored.unionByName(asking).join(load, "cell")
    mine = F.pmod(F.xxhash64("rep", "asks"), F.when(F.col("asks"), F.col("kq")).otherwise(F.col("ks"))).cast("int")
    both = both.withColumn("mine", mine).withColumn("meets", F.explode(F.sequence(F.lit(0), F.when(F.col("asks"), F.col("ks")).otherwise(F.col("kq")) - 1)))
    both = both.select("cell", F.when(F.col("asks"), F.col("meets")).otherwise(F.col("mine")).alias("s"), F.when(F.col("asks"), F.col("mine")).otherwise(F.col("meets")).alias("q"), "asks", "rep", "n", "embedding", "own", "probes")
    return both.groupBy("cell", "s", "q").applyInArrow(lambda key, batch: _block(key, batch, threshold), f"a {kind}, b {kind}, n long")


def similar_vectors(df: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL, scratch: Scratch | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row for each row of df."""
    scratch = scratch or Scratch(df.sparkSession)
    v = F.col("embedding")
    fine = F.size(v) > 0
    fine = fine & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("embedding")).withColumn("fine", F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull())
    rows = rows.withColumn("f1", F.xxhash64("embedding")).withColumn("f2", F.xxhash64(F.lit(11), "embedding"))
    reps = scratch.save(rows.where("fine").groupBy("f1", "f2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("embedding").alias("embedding")))
    sizes = [tuple(r) for r in reps.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").limit(MAX_DIMS + 1).collect()]
    found, measured = None, 1.0
    for size, n in sizes[:MAX_DIMS]:
        if n > 1:
            part, share = _links(reps.where(F.size("embedding") == size), n, threshold, recall, scratch)
            found, measured = part if found is None else found.unionByName(part), min(measured, share)
    if len(sizes) > MAX_DIMS:  # one cell for each of the other lengths
        length = F.size("embedding").cast("long")
        rest = reps.where(~length.isin([s for s, _ in sizes[:MAX_DIMS]])).select("rep", "n", "embedding", length.alias("own"), F.array(length).alias("probes"))
        found = found.unionByName(_compare(scratch.save(rest), threshold, scratch)) if found is not None else _compare(scratch.save(rest), threshold, scratch)
    heads = reps.select("f1", "f2", "rep", "n")
    if found is not None:
        found = scratch.save(found)
        counts = found.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("links"))
        roots = components(found.where("b IS NOT NULL").select("a", "b"), scratch)
        heads = heads.join(counts, F.col("rep") == F.col("a"), "left").join(roots, F.col("rep") == F.col("node"), "left")
    else:
        heads = heads.select("*", F.lit(0).alias("links"), F.lit(None).cast(df.schema[id_col].dataType).alias("root"))
    heads = heads.select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root"))
    out = rows.select("vec_id", "fine", "f1", "f2").join(heads, F.col("fine") & (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))).withColumn("measured_recall", F.lit(measured))


def op7_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors(table(spark, sf_dir, "embeddings"))
