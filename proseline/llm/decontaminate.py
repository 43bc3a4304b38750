"""Benchmark decontamination with suffix arrays over shards of the training texts.

Each Arrow shard of documents becomes an array of word hashes. A suffix array holds those of its suffixes that can carry
a match (their first words open some benchmark window; the others cannot match, so leaving them out loses nothing). All
benchmark suffixes are then binary-searched in it at once, one word of depth after another: the interval at the window's
depth is the set of verbatim occurrences, the depth at which the interval empties is the longest match.

The whole operator is narrow: no shuffle, one pass over the documents for each block of the benchmark. A block has at
most ``BLOCK_WORDS`` words, which bounds what is broadcast; a larger benchmark takes more passes, whose hits are merged
row by row. Between passes the rows are written to the shared folder, so that a task never holds more than one block. Items longer than a
block are cut into overlapping pieces. The benchmark's words are hashed in tasks; the driver puts together one block at a time.

Defined results: a null, empty or wordless text has no words, no hits and no items. Benchmark items without words match
nothing. Repeated items and items that share passages each count. A null item_id is written as an empty string. Extra
columns of the documents are left alone, but for one named contamination, which the result replaces (``decontaminate`` gives back
all columns of its input whatever their names). Words are compared by 64-bit hashes: two different windows pass for the same with
a probability of about 2^-64 for each pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Held, Scratch, fresh, mix64, shards, table, word_hashes

WINDOW = 10
BLOCK_WORDS = 2_000_000
_BITS = 20


class Block:
    """Part of a benchmark, prepared for searching."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int):
        self.window = window
        self.names = [name for name, _ in items]
        tokens, starts, owner = [], [], []
        at = 0
        self.size = []
        for k, (_, words) in enumerate(items):
            tokens.append(np.append(words, np.uint64(0)))
            n = max(1, len(words) - window + 1)
            starts.append(at + np.arange(n))
            owner.append(np.full(n, k))
            self.size.append(np.full(n, min(window, len(words))))
            at += len(words) + 1
        self.tokens = np.concatenate([*tokens, np.zeros(1, np.uint64)]) if tokens else np.zeros(1, np.uint64)
        self.starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.owner = np.concatenate(owner) if owner else np.zeros(0, np.int64)
        self.size = np.concatenate(self.size) if items else np.zeros(0, np.int64)
        self.longest = max((len(w) for _, w in items), default=0)
        self.lead = int(min(4, self.size.min())) if len(self.size) else 0
        self.first = [np.zeros(1 << _BITS, bool) for _ in range(self.lead)]
        for j in range(self.lead):
            self.first[j][self._bits(self.tokens[self.starts + j])] = True
        self.opens = np.zeros(1 << _BITS, bool)
        if self.lead:
            self.opens[self._bits(self._gram(self.tokens, self.starts))] = True

    @staticmethod
    def _bits(x: np.ndarray) -> np.ndarray:
        return (x >> np.uint64(64 - _BITS)).astype(np.int64)

    def _gram(self, tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        for j in range(self.lead):
            out = mix64(out * np.uint64(31) + tokens[np.minimum(at + j, len(tokens) - 1)])
        return out

    def candidates(self, tokens: np.ndarray) -> np.ndarray:
        """Positions whose suffix can begin with a window (with a few false ones, which the search drops)."""
        at = np.flatnonzero(self.first[0][self._bits(tokens)])
        for j in range(1, self.lead):
            at = at[at + j < len(tokens)]
            at = at[self.first[j][self._bits(tokens[at + j])]]
        return at[self.opens[self._bits(self._gram(tokens, at))]]


def suffix_array(tokens: np.ndarray, positions: np.ndarray, depth: int) -> np.ndarray:
    """positions in the order of their suffixes' first ``depth`` words; 0 ends a text and settles a suffix."""
    last = len(tokens) - 1
    sa = positions[np.argsort(tokens[positions], kind="stable")]
    if not len(sa):
        return sa
    key = tokens[sa]
    fresh = np.concatenate([[True], key[1:] != key[:-1]])
    done = key == 0
    d = 1
    while d < depth:
        group = np.cumsum(fresh) - 1
        size = np.bincount(group)
        open_ = np.flatnonzero((size[group] > 1) & ~done)
        if not len(open_):
            break
        key, own = tokens[np.minimum(sa[open_] + d, last)], group[open_]
        order = np.lexsort((key, own))
        sa[open_] = sa[open_][order]
        key = key[order]
        done[open_] = key == 0
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])])
        fresh[open_] |= new
        d += 1
    return sa


def _bisect(tokens, sa, lo, hi, depth, want, right: bool) -> np.ndarray:
    """For each interval, the first place whose word at ``depth`` is not below (right: is above) the wanted one."""
    lo, hi, last = lo.copy(), hi.copy(), len(tokens) - 1
    while True:
        live = np.flatnonzero(lo < hi)
        if not len(live):
            return lo
        mid = (lo[live] + hi[live]) >> 1
        got = tokens[np.minimum(sa[mid] + depth, last)]
        below = got <= want[live] if right else got < want[live]
        lo[live[below]] = mid[below] + 1
        hi[live[~below]] = mid[~below]


def search(block: Block, tokens: np.ndarray) -> tuple[np.ndarray, list, list]:
    """The shard's suffix array; for each benchmark suffix that fills its window, (suffix, low, high) of the window's
    occurrences; and (low, high, length) of the longest matches."""
    sa = suffix_array(tokens, block.candidates(tokens), block.longest)
    live = np.arange(len(block.starts))
    lo, hi = np.zeros(len(live), np.int64), np.full(len(live), len(sa), np.int64)
    windows, longest, d = [], [], 0
    while len(live) and len(sa):
        want = block.tokens[block.starts[live] + d]
        left = _bisect(tokens, sa, lo, hi, d, want, False)
        right = _bisect(tokens, sa, left, hi, d, want, True)
        on = (want != 0) & (left < right)
        over = ~on & (d >= block.size[live])
        longest += zip(lo[over].tolist(), hi[over].tolist(), [d] * int(over.sum()), strict=True)
        live, lo, hi = live[on], left[on], right[on]
        d += 1
        filled = block.size[live] == d
        windows += zip(live[filled].tolist(), lo[filled].tolist(), hi[filled].tolist(), strict=True)
    return sa, windows, longest


def scan(block: Block, text: pa.Array):
    """Of each text: number of words, where they are hit, items (as name sets), length of the longest verbatim match."""
    n = len(text)
    words, doc = word_hashes(text)
    tokens = np.zeros(len(words) + n + 1, np.uint64)
    tokens[np.arange(len(words)) + doc] = words
    n_words = np.bincount(doc, minlength=n)
    text_of = np.repeat(np.arange(n + 1), np.append(n_words + 1, 1))
    if not block.lead:
        return n_words, np.zeros(len(tokens), bool), text_of, {}, np.zeros(n, np.int64)
    sa, windows, longest = search(block, tokens)
    change = np.zeros(len(tokens) + 1, np.int64)
    items: dict[int, set] = {}
    seen: dict[tuple, list] = {}
    for q, lo, hi in windows:
        seen.setdefault((lo, hi, int(block.size[q])), []).append(block.names[block.owner[q]])
    for (lo, hi, size), names in seen.items():
        at = sa[lo:hi]
        change[at] += 1  # a suffix occurs once in the array
        np.add.at(change, at + size, -1)
        for k in np.unique(text_of[at]).tolist():
            items.setdefault(k, set()).update(names)
    far = np.zeros(n + 1, np.int64)
    for lo, hi, size in set(longest):
        np.maximum.at(far, text_of[sa[lo:hi]], size)
    return n_words, np.cumsum(change[:-1]) > 0, text_of, items, far[:n]


_STATE = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("hits", T.BinaryType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("longest_match", T.LongType()),
])


def blocks(benchmark: DataFrame, window: int, id_col: str, text_col: str, most: int) -> Iterator[Block]:
    """The benchmark in blocks of at most ``most`` words, one after the other (read in one streamed pass)."""
    now, count = [], 0

    def hashed(batches):
        for batch in shards(batches, "text"):
            words, doc = word_hashes(batch.column(1))
            cut = np.searchsorted(doc, np.arange(len(batch) + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([words[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary())], ["name", "words"])

    rows = benchmark.select(F.col(id_col).cast("string").alias("name"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    for name, packed in rows.mapInArrow(hashed, "name string, words binary").toLocalIterator():
        words = np.frombuffer(packed, np.uint64)
        step = max(1, most - window + 1)
        for at in range(0, max(1, len(words) - window + 1), step):
            part = words[at : at + step + window - 1]
            if not len(part):
                continue
            if now and count + len(part) > most:
                yield Block(now, window)
                now, count = [], 0
            now.append((name or "", part))
            count += len(part)
    yield Block(now, window)


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, name: str = "contamination", scratch: Scratch | None = None
) -> DataFrame:
    """docs with a struct (named ``contamination`` by default): n_words, hits (a bit for each word, packed), items and longest_match."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != name])
    spark, saved = docs.sparkSession, None
    out, scratch = docs, scratch or Scratch(docs.sparkSession)
    for k, block in enumerate(blocks(benchmark, window, item_id, item_text, block_words)):
        held = Held(spark, block)
        schema = T.StructType([f for f in docs.schema.fields] + [T.StructField(name, _STATE)])

        def run(batches, held=held, merge=k > 0):
            block = held.value
            for batch in shards(batches, text_col, 3_000_000):
                n_words, hit, text_of, items, far = scan(block, batch.column(batch.schema.get_field_index(text_col)))
                cut = np.searchsorted(text_of, np.arange(len(batch)))
                old = batch.column(batch.schema.get_field_index(name)).to_pylist() if merge else [None] * len(batch)
                rows = []
                for i in range(len(batch)):
                    bits, found, best = np.packbits(hit[cut[i] : cut[i] + n_words[i]]), items.get(i, set()), int(far[i])
                    if old[i]:
                        bits = bits | np.frombuffer(old[i]["hits"], np.uint8)
                        found, best = found | set(old[i]["items"]), max(best, old[i]["longest_match"])
                    rows.append({"n_words": int(n_words[i]), "hits": bits.tobytes(), "items": sorted(found), "longest_match": best})
                kind = pa.struct([("n_words", pa.int64()), ("hits", pa.binary()), ("items", pa.list_(pa.string())), ("longest_match", pa.int64())])
                columns = [c for c, f in zip(batch.columns, batch.schema, strict=True) if f.name != name or not merge]
                fields = [f for f in batch.schema if f.name != name or not merge]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, kind)], schema=pa.schema([*fields, pa.field(name, kind)]))

        if k:
            now = scratch.save(out)
            if saved is not None:
                scratch.drop(saved)
            out = saved = now
        out = out.mapInArrow(run, schema)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without those that hold a benchmark window."""
    name = fresh(docs, "contamination")
    found = find_contamination(docs, benchmark, name=name, **options)
    return found.where(F.size(F.col(f"{name}.items")) == 0).drop(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark")).drop("text")
    c = "contamination."
    hex_ = F.hex(c + "hits")
    # ones of a packed bit string: count of each hex digit times its number of ones
    n_hit = sum((F.length(hex_) - F.length(F.replace(hex_, F.lit(d)))) * bin(int(d, 16)).count("1") for d in "123456789ABCDEF")
    return found.select(
        "doc_id",
        F.col(c + "n_words").alias("n_words"),
        n_hit.cast("long").alias("n_hit"),
        F.size(c + "items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(c + "items"), ","), 256).alias("items_sha256"),
        (F.size(c + "items") > 0).alias("contaminated"),
        F.col(c + "longest_match").alias("longest_match"),
    )


def brute_force(texts: list, items: list[tuple], window: int = WINDOW) -> list[tuple]:
    """What op1 returns, by plain comparison (for tests)."""
    import re

    def split(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    parts = [(str(k), split(t)) for k, t in items]
    out = []
    for t in texts:
        words = split(t)
        hit, names = set(), set()
        for name, item in parts:
            size = min(window, len(item))
            for at in range(len(item) - size + 1) if size else ():
                for i in range(len(words) - size + 1):
                    if words[i : i + size] == item[at : at + size]:
                        hit.update(range(i, i + size))
                        names.add(name)
        out.append((len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out
