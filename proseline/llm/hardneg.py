"""Hard negatives from labelled vectors, by product quantisation with stored residual norms.

Components are whole numbers (256 times the given ones, rounded down); a row's score is its inner product with an anchor. A vector is cut
in stretches of ``WIDTH`` components, each with ``LEVELS`` codebooks (k-means on a bounded sample): the second holds what the first one's codewords
miss. Stored of every row are its codewords and the length of what all of them miss. An anchor's score of the codewords is off from
that of the row by at most (the anchor's length) x (the length missed). That bound is rigorous (slack is added for rounding), and with the length
as one more component it is a product with the decoded codewords, so a block of anchors and rows takes one matrix product of floats:

* positives: a row whose upper bound is under an anchor's n-th best score so far can't be among the first n;
* negatives: of each positive's window of scores, a row can count only if its bounds meet the window, above the n-th best so far.

What the bounds leave is scored exactly, in whole numbers, and completes the windows; the bounds only decide what need not be scored.

Scale. Rows are dealt out evenly first (``SPREAD`` to a part at most), since a file's row groups can be few and large and each pair of an anchor and a row is work. Anchors
are taken in rounds of at most ``ROUND_BYTES``, which is what a broadcast and the driver hold; each round is two narrow
scans over the saved rows, in blocks of ``ROWS`` x ``TILE`` pairs. A task keeps a table of its best few rows for each anchor (or window), of which a block
touches its own anchors' lines only, and hands it over; a window function that keeps only the first few of each task's merges them. No row is
shuffled by label or id, so neither can be hot. The rounds grow with the rows, as the anchors are a fixed share of them and each is held against all.

Defined results. Rows with a null label, a null vector or a null or non-finite component take no part. Vectors of different lengths are never
held against each other; each of the ``MAX_DIMS`` commonest lengths has codebooks, for others the bound is the product of the
lengths. Rows that repeat are rows of their own (each is another's positive). A null id is no anchor, keeps its label and comes last among ties. Scores beyond
64 bits count as the nearest number of 64 bits. Windows of positives with a negative score are empty. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Held, Scratch, table, utf8
from .vectors import kmeans

WIDTH, CODEWORDS, LEVELS, SAMPLE, MAX_DIMS = 4, 256, 2, 20_000, 16
ROUND_BYTES, ROWS, TILE, SPREAD = 8_000_000, 2048, 256, 16_384
#: A task's first block has so many rows, the next ones twice as many each, up to ROWS: few pairs are looked at before there are scores to beat.
FIRST = 64
#: One pair in so many left by the bounds, and a block's exact scores are a matrix product.
DENSE = 100
_FAR = np.iinfo(np.int64).max


def matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def cuts(size: int) -> list[tuple[int, int]]:
    return [(a, min(a + WIDTH, size)) for a in range(0, size, WIDTH)]


def codebooks(sample: np.ndarray) -> list[list[np.ndarray]]:
    """Of each stretch one for each level."""
    out = []
    for a, b in cuts(sample.shape[1]):
        rest, books = np.ascontiguousarray(sample[:, a:b]), []
        for _ in range(LEVELS):
            books.append(kmeans(rest, CODEWORDS, find=closest))
            rest = rest - books[-1][closest(rest, books[-1])]
        out.append(books)
    return out


def encode(x: np.ndarray, books: list[list[np.ndarray]] | None) -> tuple[np.ndarray, np.ndarray]:
    """Codewords of each stretch and level, and the length of what they miss (rounded up). Without codebooks all is missed."""
    codes, missed = [], np.zeros(len(x)) if books else (x * x).sum(1)
    for (a, b), levels in zip(cuts(x.shape[1]) if books else [], books or [], strict=True):
        rest = x[:, a:b]
        for book in levels:
            own = closest(rest, book)
            codes.append(own.astype(np.uint8))
            rest = rest - book[own]
        missed += (rest * rest).sum(1)
    return np.stack(codes, 1) if codes else np.zeros((len(x), 0), np.uint8), up(np.sqrt(missed))


def closest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The codeword of each row, nearest but for rounding."""
    scale = np.abs(book).max(initial=0) or 1.0
    words = (book / scale).astype(np.float32)
    half, turned = (words * words).sum(1) / 2, np.ascontiguousarray(words.T)
    return np.concatenate([np.zeros(0, np.int64), *[(half - (x[a : a + 2048] / scale).astype(np.float32) @ turned).argmin(1) for a in range(0, len(x), 2048)]])


def decode(codes: np.ndarray, books: list[list[np.ndarray]] | None, dims: int) -> np.ndarray:
    out, k = np.zeros((len(codes), dims)), 0
    for (a, b), levels in zip(cuts(dims) if books else [], books or [], strict=True):
        for book in levels:
            out[:, a:b] += book[codes[:, k]]
            k += 1
    return out


def up(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * (1 + 1e-6) + 1e-6).astype(np.float32), np.float32(np.inf))


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1))


class Bounds:
    """Lower and upper bounds of some anchors' scores of coded rows."""

    def __init__(self, anchors: np.ndarray, books: list[list[np.ndarray]] | None):
        self.books, self.whole = books, norms(anchors)
        self.wide = np.concatenate([anchors, self.whole[:, None]], 1)
        self.most = self.whole.max(initial=0)
        self.narrow = self.wide.astype(np.float32)

    def rows(self, codes: np.ndarray, missed: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Decoded codewords and, as one more component, what they miss, with what rounding may add to a sum of so many products."""
        dims = self.wide.shape[1] - 1
        reach = missed.astype(np.float64)
        reach += 2.0**-22 * (dims + 8) * (size + 2 * reach) + 1e-6
        return np.concatenate([decode(codes, self.books, dims), reach[:, None]], 1)

    def upper(self, rows: np.ndarray, at: slice = slice(None)) -> np.ndarray:
        """Of the anchors at. rows: what rows() gave, as floats of 32 bits too if products stay within them."""
        return (self.narrow if rows.dtype == np.float32 else self.wide)[at] @ rows.T

    def of(self, codes: np.ndarray, missed: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = self.rows(codes, missed, size)
        high = self.upper(rows)
        return high - 2 * self.whole[:, None] * rows[:, -1], high


def under(x: np.ndarray) -> np.ndarray:
    """Less than x by more than a rounded comparison can be off."""
    return x - np.where(np.isfinite(x), np.abs(x), 0) * 2.0**-20 - 1


def over(x: np.ndarray) -> np.ndarray:
    return -under(-x)


def exact(a: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray, most: float | None = None) -> np.ndarray:
    """Scores of the pairs (i, j) in whole numbers. most: no product of two rows' lengths is larger."""
    if not len(i):
        return np.zeros(0, np.int64)
    if most is None:
        most = norms(a).max(initial=0) * norms(x).max(initial=0)
    if most < 2.0**53 * 0.999:  # sums are then exact in doubles
        if len(i) * DENSE > a.shape[0] * x.shape[0]:
            form = np.float32 if most < 2.0**24 * 0.999 else np.float64
            return (a.astype(form) @ x.astype(form).T)[i, j].astype(np.int64)
        return np.concatenate([np.einsum("ij,ij->i", a[i[k : k + 8192]], x[j[k : k + 8192]]) for k in range(0, len(i), 8192)]).astype(np.int64)
    own = [{u: [int(v) for v in m[u]] for u in np.unique(k).tolist()} for m, k in ((a, i), (x, j))]
    return np.array([max(-_FAR - 1, min(_FAR, sum(p * q for p, q in zip(own[0][u], own[1][v], strict=True)))) for u, v in zip(i.tolist(), j.tolist(), strict=True)], np.int64)


class Best:
    """The first n rows of each of some lists: highest score first, ties by the smaller id. Only the lists that are added to are touched."""

    def __init__(self, n: int, lists: int = 0):
        self.n, self.count = n, np.zeros(lists, np.int64)
        self.score, self.id, self.null = (np.zeros((lists, n), np.int64) for _ in range(3))

    def _hold(self, lists: np.ndarray) -> None:
        more = int(lists.max(initial=-1)) + 1 - len(self.count)
        if more > 0:
            self.count = np.concatenate([self.count, np.zeros(more, np.int64)])
            self.score, self.id, self.null = (np.concatenate([x, np.zeros((more, self.n), np.int64)]) for x in (self.score, self.id, self.null))

    def add(self, own: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        self._hold(own)
        last = self.score[own, self.n - 1]
        good = (self.count[own] < self.n) | (score > last) | ((score == last) & (ids <= self.id[own, self.n - 1]))
        own, score, ids, null = own[good], score[good], ids[good], null[good].astype(np.int64)
        lists = np.unique(own)
        k, at = np.nonzero(np.arange(self.n) < self.count[lists][:, None])
        old = lists[k]
        own, score, ids, null = (np.concatenate(x) for x in ((old, own), (self.score[old, at], score), (self.id[old, at], ids), (self.null[old, at], null)))
        order = np.lexsort((null, ids, ~score, own))
        own = own[order]
        place = np.arange(len(own)) - np.searchsorted(own, own)
        few = place < self.n
        order, own, place = order[few], own[few], place[few]
        self.score[own, place], self.id[own, place], self.null[own, place] = score[order], ids[order], null[order]
        self.count[lists] = np.searchsorted(own, lists, "right") - np.searchsorted(own, lists)

    def least(self, lists: np.ndarray) -> np.ndarray:
        """The n-th best score of each of the lists so far, or minus infinity (also for the least number, which may stand for one below it)."""
        self._hold(lists)
        score = self.score[lists, self.n - 1]
        return np.where((self.count[lists] == self.n) & (score > -_FAR - 1), score.astype(np.float64), -np.inf)

    @property
    def kept(self) -> list[np.ndarray]:
        own, at = np.nonzero(np.arange(self.n) < self.count[:, None])
        return [own, self.score[own, at], self.id[own, at], self.null[own, at]]

    def batch(self) -> pa.RecordBatch:
        own, score, ids, null = self.kept
        return pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(ids, pa.int64(), mask=null.astype(bool)), pa.array(score, pa.int64())], ["list", "id", "score"])


def bytes_of(column: pa.Array | pa.ChunkedArray, form: type) -> np.ndarray:
    """Binary values of one size as the rows of a matrix."""
    if not len(column):
        return np.zeros((0, 0), form)
    return np.frombuffer(utf8(column)[0].tobytes(), form).reshape(len(column), -1)


def runs(labels: np.ndarray) -> dict[int, slice]:
    """Where each of some sorted labels stands."""
    begin = np.flatnonzero(np.concatenate([[True], labels[1:] != labels[:-1]]))
    return {label: slice(a, b) for label, a, b in zip(labels[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(labels)], strict=True)}


def _scan(coded: DataFrame, held, visit, n: int, slots: int) -> DataFrame:
    """Runs visit over all rows, block by block, each of one length and sorted by label; rows (list, id, score) of each task's best n."""

    def run(batches):
        anchors, books = held.value
        best = Best(n, slots * sum(len(a["row"]) for a in anchors.values()))
        bounds = {size: Bounds(a["x"], books.get(size)) for size, a in anchors.items()}
        step = dict.fromkeys(anchors, min(FIRST, ROWS))
        for batch in batches:
            sizes = batch.column(3).to_numpy()
            for size in np.unique(sizes).tolist():
                if size not in anchors:
                    continue
                part = batch.filter(pa.array(sizes == size))
                at = 0
                while at < len(part):
                    block = part.slice(at, step[size])
                    at, step[size] = at + step[size], min(ROWS, 2 * step[size])
                    block = block.take(pa.array(np.argsort(block.column(2).to_numpy(), kind="stable")))
                    x = bytes_of(block.column(4), np.float64)
                    length = norms(x)
                    most = length.max() * bounds[size].most
                    rows = bounds[size].rows(bytes_of(block.column(5), np.uint8), block.column(6).to_numpy(), length)
                    of = {
                        "row": block.column(0).to_numpy(), "id": block.column(1).fill_null(_FAR).to_numpy(), "null": block.column(1).is_null().to_numpy(zero_copy_only=False),
                        "label": block.column(2).to_numpy(), "x": x, "most": most, "rows": rows.astype(np.float32) if most < 2.0**100 else rows,
                    }
                    visit(best, anchors[size], bounds[size], of)
        yield best.batch()

    return coded.select("row", "id", "label", "size", "x", "codes", "missed").mapInArrow(run, "list long, id long, score long")


def merged(found: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("list").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def reaching(high: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose upper bound may reach their anchor's floor."""
    return np.divmod(np.flatnonzero(high >= under(floor).astype(high.dtype)[:, None]), max(1, high.shape[1]))


def positives(coded: DataFrame, held, n: int) -> DataFrame:
    """(list: the anchor's number, id, score, rank) of the first n other rows of each anchor's label."""

    def visit(best, anchors, bounds, of):
        where = runs(anchors["label"])
        for label, mine in runs(of["label"]).items():
            if label not in where:
                continue
            x, rows, row, ids, null = (of[k][mine] for k in ("x", "rows", "row", "id", "null"))
            width = max(1, TILE * ROWS // len(x))
            for at in range(where[label].start, where[label].stop, width):
                tile = slice(at, min(at + width, where[label].stop))
                number = anchors["number"][tile]
                i, j = reaching(bounds.upper(rows, tile), best.least(number))
                other = anchors["row"][tile][i] != row[j]
                i, j = i[other], j[other]
                if len(i):
                    best.add(number[i], exact(anchors["x"][tile], x, i, j, of["most"]), ids[j], null[j])

    return merged(_scan(coded, held, visit, n, 1), n)


def negatives(coded: DataFrame, held, n: int, slots: int) -> DataFrame:
    """(list: the anchor's number x slots + that of the positive, id, score, rank) of the first n rows of other labels in each window."""

    def visit(best, anchors, bounds, of):
        where = runs(of["label"])
        for at in range(0, len(anchors["row"]), TILE):
            tile = slice(at, at + TILE)
            mine = runs(anchors["label"][tile])
            if len(where) == 1 and mine.keys() == where.keys():
                continue
            begin, end = anchors["low"][tile], anchors["high"][tile]
            if not (begin <= end).any():
                continue
            lists = anchors["number"][tile][:, None] * slots + np.arange(slots)
            floor = np.where(begin <= end, np.maximum(begin.astype(np.float64), best.least(lists)), np.inf)
            high = bounds.upper(of["rows"], tile)
            for label, some in mine.items():
                if label in where:
                    high[some, where[label]] = -np.inf
            least = floor.min(1)
            i, j = reaching(high, np.where(np.isfinite(least), least, np.finfo(high.dtype).max))
            bound = high[i, j].astype(np.float64)
            reach = 2 * bounds.whole[tile][i] * of["rows"][j, -1].astype(np.float64)
            meets = np.zeros(len(i), bool)
            for p in range(slots):
                meets |= (bound >= under(floor[:, p])[i]) & (bound - reach <= over(end[:, p].astype(np.float64))[i])
            i, j = i[meets], j[meets]
            if not len(i):
                continue
            score = exact(anchors["x"][tile], of["x"], i, j, of["most"])
            k, p = np.nonzero((score[:, None] >= begin[i]) & (score[:, None] <= end[i]))
            best.add(lists[i[k], p], score[k], of["id"][j[k]], of["null"][j[k]])

    return merged(_scan(coded, held, visit, n, slots), n)


def prepared(df: DataFrame, id_col: str, label_col: str, vec_col: str, label: Column) -> DataFrame:
    v = F.col(vec_col)
    fine = F.col(label_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    whole = F.transform(v, lambda x: F.greatest(F.least(F.floor(x.cast("double") * 256.0).cast("double"), F.lit(2.0**62)), F.lit(-(2.0**62))))
    return df.where(fine).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), whole.alias("v"))


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out evenly, SPREAD to a part at most."""
    n = df.count()
    return df.repartition(max(1, -(-n // SPREAD), min(df.sparkSession.sparkContext.defaultParallelism, -(-n // 1024))))


def mine(
    df: DataFrame, anchors: Column, *, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding", label: Column | None = None,
    n_positives: int = 5, n_negatives: int = 3, share: tuple[int, int] = (50, 95), scratch: Scratch | None = None,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its first positives the first
    negatives whose score is between share[0] and share[1] hundredths of the positive's.

    anchors: a condition on ``id`` (the ids as longs). label: the label to use, where it is not the column itself."""
    spark = df.sparkSession
    scratch = scratch or Scratch(spark)
    plain = scratch.save(prepared(spread(df), id_col, label_col, vec_col, F.col(label_col) if label is None else label))
    common = [r["size"] for r in plain.groupBy(F.size("v").alias("size")).count().where("size > 0").orderBy(F.desc("count"), "size").limit(MAX_DIMS).collect()]
    books = {}
    for size in common:
        sample = plain.where(F.size("v") == size).select("v", F.xxhash64("v", "id").alias("h")).orderBy("h", "v").limit(SAMPLE).select("v").toArrow()
        books[size] = codebooks(matrix(sample.column("v")))
    held = Held(spark, books)

    def code(batches):
        books = held.value
        for batch in batches:
            sizes = np.diff(batch.column(3).offsets.to_numpy()) if len(batch) else np.zeros(0, np.int64)
            for size in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == size))
                x = matrix(part.column(3))
                codes, missed = encode(x, books.get(size))
                columns = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (x, codes)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(np.full(len(part), size), pa.int32()), *columns, pa.array(missed)], ["row", "id", "label", "size", "x", "codes", "missed"])

    coded = scratch.save(plain.select("row", "id", "label", "v").mapInArrow(code, "row long, id long, label long, size int, x binary, codes binary, missed float"))
    scratch.drop(plain)
    asked = scratch.save(coded.where(anchors).select("row", "id", "label", "size", "x"))
    widest = asked.agg(F.max("size"), F.count("*")).first()
    per_round = max(1, ROUND_BYTES // (8 * max(1, widest[0] or 1)))
    rounds = max(1, -(-widest[1] // per_round))
    out = None
    for k in range(rounds):
        # some rounds are larger than others, by chance only
        now = asked.where(F.pmod(F.xxhash64("row"), F.lit(rounds)) == k).select("row", "id", "label", "size", "x").toArrow()
        if not len(now):
            continue
        found = _round(spark, coded, now, books, n_positives, n_negatives, share, scratch)
        out = found if out is None else out.unionByName(found)
    kind = df.schema[id_col].dataType
    if out is None:
        out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return out.withColumns({c: F.col(c).cast(kind) for c in ("anchor_id", "positive_id", "negative_id")})


def _round(spark: SparkSession, coded: DataFrame, now: pa.Table, books: dict, n_positives: int, n_negatives: int, share: tuple[int, int], scratch: Scratch) -> DataFrame:
    sizes = now.column("size").to_numpy()
    anchors = {}
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        at = at[np.argsort(now.column("label").to_numpy()[at], kind="stable")]
        part = now.take(pa.array(at))
        anchors[size] = {"number": at, "row": part.column("row").to_numpy(), "label": part.column("label").to_numpy(), "x": bytes_of(part.column("x"), np.float64)}
    found = positives(coded, Held(spark, (anchors, books)), n_positives).toArrow()  # at most n_positives for each anchor of the round
    number, rank, score = (found.column(c).to_numpy() for c in ("list", "rank", "score"))
    begin, end = np.zeros((len(now), n_positives), np.int64), np.full((len(now), n_positives), -1, np.int64)
    window = [(-(-share[0] * s // 100), share[1] * s // 100) if s >= 0 else (0, -1) for s in score.tolist()]
    begin[number, rank - 1], end[number, rank - 1] = [w[0] for w in window], [w[1] for w in window]
    for a in anchors.values():
        a["low"], a["high"] = begin[a["number"]], end[a["number"]]
    best = scratch.save(negatives(coded, Held(spark, (anchors, books)), n_negatives, n_positives))
    ids = now.column("id").to_pylist()
    heads = list(zip((number * n_positives + rank - 1).tolist(), [ids[k] for k in number.tolist()], found.column("id").to_pylist(), score.tolist(), strict=True))
    # as many rows as the round has positives
    heads = spark.createDataFrame(heads, "list long, anchor_id long, positive_id long, positive_score long")
    return best.join(F.broadcast(heads), "list").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"), F.col("id") % 50 == 0, label=label)


def brute_force(rows: list[tuple], n_positives: int = 5, n_negatives: int = 3) -> list[tuple]:
    """What op12 returns for rows (vec_id, label, vector), pair by pair (for tests)."""
    import math

    kept = []
    for i, label, v in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, int(math.fmod(label + 1, 10)) if i is not None and i % 7 == 0 else label, [math.floor(256 * float(x)) for x in v]))
    out = []
    for k, (i, label, v) in enumerate(kept):
        if i is None or i % 50:
            continue
        scored = [(-sum(p * q for p, q in zip(v, w, strict=True)), j is None, j if j is not None else 0, l) for m, (j, l, w) in enumerate(kept) if m != k and len(w) == len(v)]
        scored.sort()
        for s, null, j, _ in [x for x in scored if x[3] == label][:n_positives]:
            few = [x for x in scored if x[3] != label and 50 * -s <= 100 * -x[0] <= 95 * -s][:n_negatives]
            out += [(i, None if null else j, r, None if x[1] else x[2], -s, -x[0]) for r, x in enumerate(few, 1)]
    return out
