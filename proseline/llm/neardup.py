"""MinHash near-duplicates with DartMinHash signatures.

A document is the weighted set of its five-word shingles, a shingle's weight being how often it occurs; similarity is the weighted
Jaccard index, and 0.8 or more makes a link. Every unit of weight owns a Poisson process of hashed darts on a rank axis, which
is the same in whatever document the unit stands. A document looks only at darts below a rank that gives it about k ln k + 2k
of them, however long it is; each dart carries one of k coordinates, and the lowest of each coordinate makes the
signature (documents that leave a coordinate empty double their rank). Two documents agree in a coordinate with the
probability of their weighted Jaccard index. The signature is cut into bands; equal bands make candidates.

Scale. Exact copies (equal word sequences) are first reduced to their smallest id, map-side aggregated. Buckets are not expanded
into pairs. First each member is compared with its bucket's smallest id, exactly; that settles families of near copies
in one comparison for each text. Buckets whose members are then still of several components are gone through whole: each text outside
the bucket's largest component meets every text of the bucket, so that every pair that shares a band and isn't connected already is
compared, and no link is lost to a choice of pivots. Components are made of verified links only, so chance ties don't grow
together. Texts travel in blocks of at most about ``CHUNK`` texts and ``CHUNK_WORDS`` words, once for each pivot or block, and a
hot bucket is many tasks' work; a block hands over only links that span what it found linked. Other texts are not shuffled.

Defined results: the answer has one row for each input row. A text without words (null, empty, punctuation) links with nothing.
A text of one to four words is one shingle. Ties go to the smallest id. Rows with the same id count as one document whose texts
all link; a null id gives a null component and is kept. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MIX3, Scratch, components, join_heads, mix64, release, shards, table, word_hashes

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 5
CHUNK, CHUNK_WORDS = 256, 400_000
FILTER_BITS = 1 << 26


def shingles(words: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of n texts, sorted by text and hash, and the text of each."""
    size = np.bincount(doc, minlength=n)
    start = np.cumsum(size) - size
    short = np.flatnonzero((size > 0) & (size < SHINGLE))
    at = np.flatnonzero(np.arange(len(words)) + SHINGLE <= (start + size)[doc]) if len(words) else np.zeros(0, np.int64)
    h = np.zeros(len(at), np.uint64)
    for j in range(SHINGLE):
        h = mix64(h * MIX3 + words[at + j])
    few = np.zeros(len(short), np.uint64)
    for j in range(SHINGLE - 1):
        on = size[short] > j
        few[on] = mix64(few[on] * MIX3 + words[start[short[on]] + j] + np.uint64(1))
    h, own = np.concatenate([h, few]), np.concatenate([doc[at], short])
    order = np.lexsort((h, own))
    return h[order], own[order]


def signatures(h: np.ndarray, own: np.ndarray, n: int, k: int = BANDS * ROWS) -> np.ndarray:
    """n x k dart ids (0 throughout for a text without shingles); h and own as from shingles()."""
    out = np.zeros((n, k), np.uint64)
    if not len(h):
        return out
    fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (own[1:] != own[:-1])])
    first = np.flatnonzero(fresh)
    nth = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
    unit = mix64(h + nth.astype(np.uint64) * MIX3)
    total = np.bincount(own, minlength=n)
    reach = (k * np.log(k) + 2 * k) / np.maximum(total, 1)
    todo = total > 0
    while todo.any():
        mine = np.flatnonzero(todo[own])
        element, text, rank = unit[mine], own[mine], np.zeros(len(mine))
        low, step, keys, ranks, darts = np.full(n * k, np.inf), np.zeros(1, np.uint64), [], [], []
        while len(element):
            step += np.uint64(1)
            dart = mix64(element + step * MIX3)
            rank = rank - np.log(((dart >> np.uint64(11)).astype(np.float64) + 1) / 9007199254740992.0)
            on = rank <= reach[text]
            element, text, rank, dart = element[on], text[on], rank[on], mix64(dart[on] ^ MIX3)
            key = text * k + (dart % np.uint64(k)).astype(np.int64)
            np.minimum.at(low, key, rank)
            keys.append(key)
            ranks.append(rank)
            darts.append(dart)
        key, rank, dart = np.concatenate(keys), np.concatenate(ranks), np.concatenate(darts)
        wins = rank == low[key]
        out.reshape(-1)[key[wins]] = dart[wins] | np.uint64(1)
        todo &= np.isinf(low.reshape(n, k)).any(1)
        reach[todo] *= 2
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    """n x BANDS hashes of the bands."""
    out = np.zeros((len(sig), BANDS), np.uint64)
    for b in range(BANDS):
        h = np.full(len(sig), b + 1, np.uint64)
        for j in range(ROWS):
            h = mix64(h * MIX3 + sig[:, b * ROWS + j])
        out[:, b] = h
    return out


def units(h: np.ndarray, own: np.ndarray) -> np.ndarray:
    """A hash for each unit of weight (a shingle and how many of it came before); h and own as from shingles()."""
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (own[1:] != own[:-1])])) if len(h) else np.zeros(0, np.int64)
    nth = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
    return mix64(h + nth.astype(np.uint64) * MIX3)


def links(texts: pa.Array, left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (of a text in left and another in right) whose weighted Jaccard index is at least the threshold.

    Units are sets whose plain Jaccard index is the weighted one; their common elements are counted through posting lists."""
    n = len(texts)
    h, own = shingles(*word_hashes(texts), n)
    size = np.bincount(own, minlength=n)
    _, number = np.unique(units(h, own), return_inverse=True)
    start = np.cumsum(size) - size
    among = np.isin(own, right)
    order = np.argsort(number[among], kind="stable")
    posted, key = own[among][order], number[among][order]
    begin = np.searchsorted(key, np.arange(number.max(initial=-1) + 2))
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for x in left:
        mine = number[start[x] : start[x] + size[x]]
        at, count = begin[mine], begin[mine + 1] - begin[mine]
        place = np.arange(count.sum()) + np.repeat(at - (np.cumsum(count) - count), count)
        both = np.bincount(posted[place], minlength=n)
        ok = np.flatnonzero(both >= threshold * (size + size[x] - both) - 1e-9)
        ok = ok[(ok != x) & (both[ok] > 0)]
        found_a.append(np.full(len(ok), x))
        found_b.append(ok)
    return np.concatenate(found_a), np.concatenate(found_b)


def _block(batch: pa.Table, threshold: float) -> pa.Table:
    """Links a, b that span what is linked between the rows of a block that ask and those that answer."""
    ids = batch.column("id").combine_chunks()
    asks = batch.column("asks").to_numpy(zero_copy_only=False).astype(bool)
    left, right = sorted((np.flatnonzero(asks), np.flatnonzero(~asks)), key=len)
    a, b = links(batch.column("text").combine_chunks(), left, right, threshold)
    label = np.arange(len(ids))
    while len(a):
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        if (before == label).all():
            break
    tied = np.flatnonzero(label != np.arange(len(ids)))
    if len(ids) >= CHUNK:
        release()
    return pa.table({"a": ids.take(pa.array(tied)), "b": ids.take(pa.array(label[tied]))})


def _prepare(docs: DataFrame) -> DataFrame:
    """doc_id, f1 and f2 (fingerprint of the words), n_words, bands (of the first text with a fingerprint in a shard)."""
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("f1", "f2", "n_words")), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in shards(batches, "text", 1_000_000):
            n = len(batch)
            words, doc = word_hashes(batch.column(1))
            size = np.bincount(doc, minlength=n)
            place = np.arange(len(words)) - np.repeat(np.cumsum(size) - size, size)
            prints = []
            for seed in (3, 7):  # sums of hashes of word and place
                total = np.zeros(n, np.uint64)
                np.add.at(total, doc, mix64(words + mix64(place.astype(np.uint64) * MIX3 + np.uint64(seed))))
                prints.append(mix64(total + size.astype(np.uint64)).view(np.int64))
            _, head = np.unique(np.stack(prints), axis=1, return_index=True)
            new = np.zeros(n, bool)
            new[head] = True
            new &= size > 0
            rank = np.cumsum(new) - 1
            keep = new[doc]
            keys = bands(signatures(*shingles(words[keep], rank[doc[keep]], int(new.sum())), int(new.sum()))).view(np.int64)
            offsets = np.concatenate([[0], np.cumsum(np.where(new, BANDS, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1)), mask=pa.array(~new))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p) for p in prints), pa.array(size, pa.int64()), lists], ["doc_id", "f1", "f2", "n_words", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _likely(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Those rows whose id's hash is set in a bitmap of the ids' hashes: all that are among the ids and some that aren't.

    It keeps other texts out of the shuffle. The bitmap has FILTER_BITS bits in pieces of 32768, at most 8 MB, whatever the number of ids."""
    spot = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    bits = ids.select(spot.alias("spot")).groupBy(F.floor(F.col("spot") / 32768).alias("piece")).agg(F.bitmap_construct_agg((F.col("spot") % 32768)).alias("bits"))
    at = F.col("spot") % 32768
    byte = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    near = rows.withColumn("spot", spot).withColumn("piece", F.floor(F.col("spot") / 32768)).join(F.broadcast(bits), "piece")
    return near.where(F.getbit(byte, (at % 8).cast("int")) == 1).select(*rows.columns)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, component_id (the smallest id that links reach) and kept, a row for each row of docs."""
    scratch = scratch or Scratch(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = scratch.save(_prepare(docs))
    some = rows.where("n_words > 0 AND doc_id IS NOT NULL")
    groups = scratch.save(some.groupBy("f1", "f2").agg(F.min("doc_id").alias("id"), F.first("bands", ignorenulls=True).alias("bands"), F.first("n_words").alias("n_words")))
    # copies keep their smallest id; ids of rows with several texts link those texts
    same = some.join(groups.select("f1", "f2", "id"), ["f1", "f2"]).where("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    several = groups.groupBy("id").count().where("count > 1").limit(1).count() or some.groupBy("doc_id").agg(F.countDistinct("f1", "f2").alias("k")).where("k > 1").limit(1).count()
    members = groups.select("id", "n_words", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("rows"), F.sum("n_words").alias("words")).where("rows > 1")
    tied = scratch.save(join_heads(members, scratch.save(buckets), "key", 24 * groups.count()))
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    texts = scratch.save(_likely(texts, tied.select("id")))
    if several:
        texts = texts.dropDuplicates(["id", "text"])

    def compare(rows: DataFrame, *keys: str) -> DataFrame:
        blocks = rows.join(texts, "id").groupBy(*keys)
        return scratch.save(blocks.applyInArrow(lambda batch: _block(batch, threshold), f"a {kind}, b {kind}"))

    # each member with its bucket's smallest id
    chunks = lambda n, words: F.greatest(F.ceil(n / CHUNK), F.ceil(words / CHUNK_WORDS)).cast("int").alias("chunks")
    pairs = scratch.save(tied.where("id <> least").groupBy("id", "least").agg(F.first("n_words").alias("n_words")))
    pivots = scratch.save(pairs.groupBy("least").agg(chunks(F.count("*"), F.sum("n_words")), F.count("*").alias("rows")))
    asks = join_heads(pairs, pivots, "least", pairs.count()).select("least", F.pmod(F.xxhash64("id"), "chunks").cast("int").alias("part"), "id", F.lit(True).alias("asks"))
    answers = pivots.select("least", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("part"), F.col("least").alias("id"), F.lit(False).alias("asks"))
    first = compare(asks.unionByName(answers), "least", "part")
    # buckets that are not of one component by now
    known = components(first, scratch)
    grouped = scratch.save(tied.select("key", "id", "n_words").join(known, F.col("id") == F.col("node"), "left").select("key", "id", "n_words", F.coalesce("root", "id").alias("grp")))
    parts = grouped.groupBy("key", "grp").agg(F.count("*").alias("n"), F.sum("n_words").alias("words"))
    most = F.max(F.struct("n", "grp", "words"))
    sized = parts.groupBy("key").agg(F.count("*").alias("k"), most["grp"].alias("top"), F.sum("n").alias("rows"), F.sum("words").alias("words"), most["n"].alias("top_n"), most["words"].alias("top_words")).where("k > 1")
    sized = sized.select("key", "rows", "top", chunks(F.col("rows"), F.col("words")).alias("ka"), chunks(F.col("rows") - F.col("top_n"), F.col("words") - F.col("top_words")).alias("ko"))
    open_ = scratch.save(join_heads(grouped, scratch.save(sized), "key", grouped.count()))
    upto = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    mine = lambda k: F.pmod(F.xxhash64("id"), k).cast("int")
    asks = open_.where("grp <> top").select("key", mine("ko").alias("i"), upto("ka").alias("j"), "id", F.lit(True).alias("asks"))
    answers = open_.select("key", upto("ko").alias("i"), mine("ka").alias("j"), "id", F.lit(False).alias("asks"))
    found = first.unionByName(compare(asks.unionByName(answers), "key", "i", "j"))
    roots = components(found, scratch)
    if several:
        roots = components(found.unionByName(same), scratch)
        out = rows.join(roots, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("root", "doc_id").alias("component_id"))
    else:
        heads = groups.select("f1", "f2", "id").join(roots, F.col("id") == F.col("node"), "left").select("f1", "f2", F.coalesce("root", "id").alias("id"))
        keyed = F.col("n_words") > 0
        out = rows.join(heads.select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), "id"), keyed & (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")), "left")
        out = out.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """docs without those that a near duplicate with a smaller id stands for."""
    gone = near_duplicates(docs, **options).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
