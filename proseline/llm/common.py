"""What the training-data operators share: scratch tables, UTF-8 columns as numpy arrays, word hashes, graph components."""

from __future__ import annotations

import atexit
import ctypes
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Workers need not have the package installed: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules["proseline"])

_OWN: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input. The session's Arrow batch size holds; operators cut batches of texts by bytes themselves (shards)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have (Spark's names don't tell case): the one given, or with underscores added."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Where it is unset a temporary folder does, but only if the executors
    are threads of this machine (local masters); on a cluster that is an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = "file://" + tempfile.mkdtemp(prefix="proseline-")
    return _OWN["dir"]


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Held:
    """A broadcast of anything, of the package's own classes too: what travels is a pickle by value, so workers need no package. Read once a task."""

    def __init__(self, spark: SparkSession, value):
        self.packed, self.read = spark.sparkContext.broadcast(cloudpickle.dumps(value)), []

    def drop(self) -> None:
        """Frees it, once nothing reads it any more."""
        self.packed.destroy()

    @property
    def value(self):
        if not self.read:
            self.read.append(cloudpickle.loads(self.packed.value))
        return self.read[0]


class Scratch:
    """Tables in the shared folder that cut lineage: a lost executor costs a re-read, not a recomputation.

    Whatever is still there when the Python process ends is deleted then.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []
        atexit.register(self.close)

    def path(self) -> str:
        self.paths.append(f"{shared_dir(self.spark)}/proseline/{uuid.uuid4().hex}")
        return self.paths[-1]

    def save(self, df: DataFrame, codec: str | None = None) -> DataFrame:
        """codec: zstd for tables that are large for what they are worth."""
        path = self.path()
        (df.write.option("compression", codec) if codec else df.write).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_scratch_path", None)
        if path in self.paths:
            self.paths.remove(path)
            remove(self.spark, path)

    def close(self) -> None:
        try:
            for p in self.paths:
                remove(self.spark, p)
        except Exception:  # noqa: BLE001 - the session is gone; a cluster's own cleaner takes the folder
            pass
        self.paths = []


def bucket_of(doc_id: Column | str, n: int = 5) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % n


# --- UTF-8 columns ---------------------------------------------------------------------------------------------------

MIX1, MIX2, MIX3 = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and ends of a string or binary column; a null is an empty extent."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n, np.int64), np.zeros(n, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    body = body[off[0] : off[-1]]
    off = off - off[0]
    starts, ends = off[:-1].copy(), off[1:].copy()
    if column.null_count:
        gone = np.asarray(column.is_null().to_numpy(zero_copy_only=False), bool)
        ends[gone] = starts[gone]
    return body, starts, ends


def release() -> None:
    """Hands freed memory back to the system: a worker that is used again by other operators would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def shards(batches, column: str, most: int = 6_000_000):
    """Record batches cut so that the text of each has at most so many bytes (a single longer text stands alone)."""
    for n, batch in enumerate(batches):
        if n % 16 == 15:
            release()
        i = batch.schema.get_field_index(column)
        sizes = np.zeros(len(batch), np.int64) if len(batch) == 0 else (lambda x: x[2] - x[1])(utf8(batch.column(i)))
        at, total = 0, 0
        for k, size in enumerate(sizes.tolist()):
            if k > at and total + size > most:
                yield batch.slice(at, k - at)
                at, total = k, 0
            total += size
        if at < len(batch):
            yield batch.slice(at)
    release()


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Digits, lower-case letters and every byte of a character beyond ASCII.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def extents(inside: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of True that don't cross a text's border: begins, ends, index of the text."""
    n = len(inside)
    if n == 0:
        return (np.zeros(0, np.int64),) * 3
    full = ends > starts
    s, e = starts[full], ends[full]
    own = np.zeros(n + 1, np.int8)
    np.add.at(own, s, 1)
    np.add.at(own, e, -1)
    if (np.cumsum(own[:-1], dtype=np.int8) != 1).any():  # bytes under a null
        inside = inside & (np.cumsum(own[:-1], dtype=np.int8) == 1)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[s] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[e - 1] = False
    begin, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return begin, end, np.flatnonzero(full)[np.searchsorted(s, begin, side="right") - 1]


def hash_extents(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte strings, eight bytes at a time; never 0."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(data) + 1,), np.dtype("<u8"), padded.data, 0, (1,))
    size = end - begin
    out = mix64(size.astype(np.uint64) + MIX3)
    live = np.arange(len(begin))
    at = 0
    while len(live):
        rest = size[live] - at
        chunk = words[begin[live] + at] & _MASK[np.minimum(rest, 8)]
        out[live] = mix64(out[live] * MIX3 ^ chunk)
        at += 8
        live = live[rest > 8]
    out[out == 0] = 1
    return out


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of the words (A-Z lowered; runs of digits, letters and all characters beyond ASCII): hashes, index of the text."""
    data, starts, ends = utf8(column)
    low = LOWER[data]
    begin, end, doc = extents(WORD[low], starts, ends)
    return hash_extents(low, begin, end), doc


def word_parts(column: pa.Array, prefixes: tuple[int, ...]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """As word_hashes, with hashes of each word's first bytes (for every length, at most 8, in prefixes)."""
    data, starts, ends = utf8(column)
    low = LOWER[data]
    begin, end, doc = extents(WORD[low], starts, ends)
    padded = np.concatenate([low, np.zeros(8, np.uint8)])
    head = np.ndarray((len(low) + 1,), np.dtype("<u8"), padded.data, 0, (1,))[begin] if len(begin) else np.zeros(0, np.uint64)
    size = end - begin
    return hash_extents(low, begin, end), [mix64((head & _MASK[np.minimum(size, k)]) + np.uint64(k)) for k in prefixes], doc


# --- Joins with few heads for many rows ------------------------------------------------------------------------------

#: Keys that hold more than 1 in HOT_SHARE of all rows are hot: there are fewer than HOT_SHARE of them, whatever the table's size.
HOT_SHARE = 5000


def join_heads(rows: DataFrame, heads: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with heads, which has one row for each key and in ``rows`` how many of the ``total`` rows have that key.

    Heads of hot keys (fewer than HOT_SHARE, which is also all that reaches the driver) are broadcast, so that their rows stay where they are; other
    keys' rows are shuffled. Both tables are read twice and should be saved ones."""
    bound = F.lit(total / HOT_SHARE)
    keys = [r[0] for r in heads.where(F.col("rows") > F.greatest(bound, F.lit(100))).select(key).collect()]
    if not keys:
        return rows.join(heads.drop("rows"), key)
    hot = F.col(key).isin(keys)
    return rows.where(hot).join(F.broadcast(heads.where(hot).drop("rows")), key).unionByName(rows.where(~hot).join(heads.where(~hot).drop("rows"), key))


# --- Connected components --------------------------------------------------------------------------------------------


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root (the smallest node that links reach), for every node that has an edge a, b.

    Alternating large and small stars; each round is a map-side combined minimum and a join on the node. Hot nodes are joined by
    broadcast (join_heads), so no node's neighbours meet in one task. Rounds grow with the logarithm of the longest chain.
    """
    now = scratch.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark, found = None, (now.count(), None)
    while found != mark and found[0]:
        mark = found
        both = scratch.save(now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        least = scratch.save(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("rows")).select("u", F.least("u", "m").alias("m"), "rows"))
        large = scratch.save(join_heads(both, least, "u", 2 * found[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        second = scratch.save(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("rows")))
        small = join_heads(large, second, "u", found[0]).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        new = scratch.save(small.select("e.u", "e.v").where("u <> v").distinct())
        for old in (now, both, least, large, second):
            scratch.drop(old)
        now = new
        found = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    roots = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return scratch.save(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()))
