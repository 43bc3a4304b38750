"""Cross-tokenizer alignment with segment deduplication.

Texts, with a space before them, are cut into segments before white space that follows another character, where both vocabularies
verifiably can't merge across: no token of either holds a character other than white space right before that white-space character
(``Pair.breaks`` looks through both vocabularies; characters that fail are no cutting places), and the byte-level splitter has no
alternative that spans such a place. So a segment's tokens are the same in every text. Distinct segments are tokenised and aligned once, the
alignments are joined back, and documents are put together from them.

How it is done. Documents are read in blocks of at most ``BLOCK_BYTES``. A block keeps each of its segments once and its documents as
numbers of segments (dictionary encoding), so what is shuffled grows with the distinct segments of blocks, not with the words; a hot segment is one row
a block. Segments are shuffled and sorted, so that each is tokenised once, for all blocks that have it; an alignment is kept as its links in order, with a flag where a token of A or B begins, from
which tokens and groups follow. The joined alignments come back by block, where the
block's documents are composed in numpy: a block also counts in how many of its documents each pair of ids is linked, once for each
pair. Sums of these give the corpus-wide counts, which come back by block in the same way.

Definitions. Token bytes: of the byte-level vocabulary A the bytes that its entries stand for, of the piece vocabulary B the piece with
U+2581 as a space, or the byte of a byte piece. Byte offsets where tokens of both end cut them into groups. Links are all A-B token occurrences
whose byte ranges overlap. The count of an id pair is the number of documents that hold it linked.

Defined results: null and empty texts, and texts whose joined A or B bytes are not those of the space and the text (for example with a U+2581 of
their own), have no tokens: zeros and an empty groups_sha256. Strings of special tokens are plain text. Repeated rows are documents each. A text without white
space is one segment, whatever its length. Extra columns stay, but for the text and those with a result's name.
"""

from __future__ import annotations

import bisect
import hashlib
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, release, shards, table, utf8

BLOCK_BYTES, BATCH, SLICE = 12_000_000, 10_000, 300_000
RESULTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
#: White space beyond ASCII, as UTF-8: no cut is made after it (nor after ASCII white space and the separators 1C to 1F).
_WIDE = [b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", *[b"\xe2\x80" + bytes([k]) for k in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)], b"\xe2\x81\x9f", b"\xe3\x80\x80"]
NEW_A, NEW_B = 1, 2
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


class Pair:
    """Both tokenizers: their ids of segments, the bytes of each id, and before which characters texts may be cut."""

    def __init__(self, a: str, b: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        spec = json.loads(a)
        pre = spec["pre_tokenizer"] or {}
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("the first tokenizer must be a plain byte-level one")
        self.a = Tokenizer.from_str(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        shown = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c <= 255]
        hidden = [c for c in range(256) if c not in set(shown)]
        byte = {chr(c): c for c in shown} | {chr(256 + k): c for k, c in enumerate(hidden)}
        size = max(spec["model"]["vocab"].values()) + 1
        tokens = [b""] * size
        for t, i in spec["model"]["vocab"].items():
            tokens[i] = bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode()
        n = self.b.get_piece_size()
        pieces = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(n)))]
        self.tokens, self.pieces = Table(tokens), Table(pieces)
        number = "<u2" if max(size, n) <= 1 << 16 else "<u4"
        self.link = np.dtype([("a", number), ("b", number), ("new", "u1")])
        self.breaks = bytes(c for c in b" \n\t\r\v\f" if not any(self.crosses(t, c) for t in (*tokens, *pieces)))

    @staticmethod
    def crosses(token: bytes, c: int) -> bool:
        """Whether the token holds c after another character, or (which would take in the space that B adds) after a first space."""
        at = token.find(c)
        while at >= 0:
            space = at > 0 and (_SPACE[token[at - 1]] or token[:at].endswith(tuple(_WIDE)))
            if at > 0 and (not space or (c != 32 and token[:at] == b" ")):
                return True
            at = token.find(c, at + 1)
        return False

    def encode(self, segments: list[str]) -> tuple[Ragged, Ragged]:
        a = Ragged([e.ids for e in self.a.encode_batch(segments, add_special_tokens=False)])
        # B adds a space (but to nothing), which is there already or (before another white space) is the first token by itself
        bare = [not s.startswith(" ") for s in segments]
        b = self.b.encode([s if lone else s[1:] for s, lone in zip(segments, bare, strict=True)], num_threads=1)
        space = [self.b.piece_to_id("▁")]
        return a, Ragged([ids[1:] if lone else ids or space for ids, lone in zip(b, bare, strict=True)])


class Ragged:
    """Lists of numbers, side by side."""

    def __init__(self, lists: list[list[int]]):
        self.size = np.array([len(x) for x in lists], np.int64)
        self.values = np.fromiter((v for x in lists for v in x), np.int64, int(self.size.sum()))
        self.own = np.repeat(np.arange(len(lists)), self.size)


class Table:
    """Byte strings by id."""

    def __init__(self, parts: list[bytes]):
        self.size = np.array([len(p) for p in parts], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(parts), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.data[spread(self.start[ids], self.size[ids])]


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (size numbers) for each."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


def cut(data: np.ndarray, starts: np.ndarray, breaks: bytes) -> np.ndarray:
    """Where segments begin in texts that begin at ``starts`` (and fill the data)."""
    may = np.zeros(256, bool)
    may[list(breaks)] = True
    at = np.flatnonzero(may[data[1:]] & ~_SPACE[data[:-1]]) + 1
    wide = at[data[at - 1] >= 128]
    if len(wide):
        bad = np.zeros(len(wide), bool)
        for w in _WIDE:
            fits = wide >= len(w)
            for k, byte in enumerate(w):
                fits &= data[np.maximum(wide - len(w) + k, 0)] == byte
            bad |= fits
        at = np.setdiff1d(at, wide[bad], assume_unique=True)
    return np.union1d(at, starts)


def align(segments: list[str], pair: Pair) -> pa.Array:
    """The links (``Pair.link``) of segments, packed; null where the tokens' bytes are not the segment's."""
    raw = [s.encode() for s in segments]
    data, size = np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw], np.int64)
    n = len(raw)
    found = pair.encode(segments)
    fine = np.ones(n, bool)
    for ids, bytes_ in zip(found, (pair.tokens, pair.pieces), strict=True):
        total = np.bincount(ids.own, bytes_.size[ids.values], n).astype(np.int64)
        good = total == size
        keep = good[ids.own]
        same = bytes_.joined(ids.values[keep]) == data[np.repeat(good, size)]
        good[np.repeat(np.flatnonzero(good), size[good])[~same]] = False
        fine &= good
    a, b = ({"id": ids.values[keep], "own": ids.own[keep], "size": bytes_.size[ids.values[keep]]} for ids, bytes_ in zip(found, (pair.tokens, pair.pieces), strict=True) for keep in [fine[ids.own]])
    for x in (a, b):  # segments that are fine lie side by side, and so do their tokens
        x["end"] = np.cumsum(x["size"])
        x["begin"] = x["end"] - x["size"]
    # links: of an A token the B tokens from the first that ends after its begin to the last that begins before its end
    full = np.flatnonzero(a["size"] > 0)
    first, last = np.searchsorted(b["end"], a["begin"][full], side="right"), np.searchsorted(b["begin"], a["end"][full], side="left")
    many = last - first
    at_b = spread(first, many)
    links = np.zeros(len(at_b), pair.link)
    links["a"], links["b"] = np.repeat(a["id"][full], many), b["id"][at_b]
    links["new"][np.cumsum(many) - many] = NEW_A
    links["new"][np.concatenate([[True], at_b[1:] != at_b[:-1]]) if len(at_b) else slice(0)] |= NEW_B
    n_links = np.bincount(np.repeat(a["own"][full], many), minlength=n)
    offsets = pa.array(np.concatenate([[0], np.cumsum(n_links)]) * pair.link.itemsize, pa.int32())
    packed = pa.BinaryArray.from_buffers(pa.binary(), n, [None, offsets.buffers()[1], pa.py_buffer(links.tobytes())])
    return pc.if_else(pa.array(fine), packed, pa.scalar(None, pa.binary()))


def squeeze(values: np.ndarray) -> bytes:
    """Whole numbers under 2^32, compressed byte by byte: all lowest ones first, without bytes that all lack."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = values.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].T.tobytes()
    return bytes([width]) + len(planes).to_bytes(6, "little") + pa.compress(planes, "zstd", asbytes=True)


def unsqueeze(packed: bytes) -> np.ndarray:
    width, size = packed[0], int.from_bytes(packed[1:7], "little")
    planes = np.frombuffer(pa.decompress(packed[7:], size, "zstd", asbytes=True), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 4), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u4").reshape(-1).astype(np.int64)


def unsqueezed(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a squeezed column, and how many each row has (a null: none)."""
    rows = [unsqueeze(x) if x else np.zeros(0, np.int64) for x in column.to_pylist()]
    return np.concatenate([np.zeros(0, np.int64), *rows]), np.array([len(r) for r in rows], np.int64)


def written(links: np.ndarray, own: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The groups of n segments as text, side by side, each group with a semicolon after it; and their sizes. own: the segment of each link."""
    new_a, new_b = links["new"] & NEW_A > 0, links["new"] & NEW_B > 0
    group = np.cumsum(new_a & new_b)
    ids = np.concatenate([links["a"][new_a], links["b"][new_b]]).astype(np.int64)
    key = np.concatenate([2 * group[new_a], 2 * group[new_b] + 1])
    order = np.argsort(key, kind="stable")
    ids, key = ids[order], key[order]
    kinds, which = np.unique(ids, return_inverse=True)
    digits = Table([str(k).encode() for k in kinds.tolist()])
    size = digits.size[which] + 1
    out = np.empty(int(size.sum()), np.uint8)
    ends = np.cumsum(size)
    closing = np.append(key[1:] != key[:-1], True) if len(key) else np.zeros(0, bool)
    out[ends - 1] = np.where(closing, np.where(key % 2 == 0, ord("|"), ord(";")), ord(","))
    out[spread(ends - size, size - 1)] = digits.joined(which)
    owner = np.concatenate([own[new_a], own[new_b]])[order]
    return out, np.bincount(owner, size, n).astype(np.int64)


def _cutter(text_col: str, rest: list[str], breaks: bytes):
    """Blocks of documents: rows of documents (their segments' numbers) and rows of segments (their number in the block)."""

    def run(batches):
        number, none = TaskContext.get().partitionId() << 32, pa.scalar(None, pa.string())
        for batch in shards(batches, text_col, BLOCK_BYTES):
            raw, starts, ends = utf8(batch.column(batch.schema.get_field_index(text_col)))
            full = ends > starts
            size = ends - starts + full
            begins = np.cumsum(size) - size
            data = np.full(int(size.sum()), ord(" "), np.uint8)
            for s, e, b in zip(starts[full].tolist(), ends[full].tolist(), begins[full].tolist(), strict=True):
                data[b + 1 : b + 1 + e - s] = raw[s:e]
            begins = begins[full]
            at = cut(data, begins, breaks) if len(data) else np.zeros(0, np.int64)
            offsets = np.append(at, len(data)).astype(np.int64)
            coded = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
            per_doc = np.zeros(len(size), np.int64)
            per_doc[full] = np.diff(np.append(np.searchsorted(at, begins), len(at)))
            # frequent segments get small numbers
            often = np.argsort(-np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary)), kind="stable")
            number_of = np.empty(len(often), np.int64)
            number_of[often] = np.arange(len(often))
            ids, upto = number_of[coded.indices.to_numpy()], np.cumsum(per_doc).tolist()
            lists = pa.array([squeeze(ids[j - k : j]) if k else None for j, k in zip(upto, per_doc.tolist(), strict=True)], pa.binary())
            n, known = len(batch), coded.dictionary.take(pa.array(often)).cast(pa.string())
            schema = pa.schema([*[batch.schema.field(batch.schema.get_field_index(c)).with_nullable(True) for c in rest], ("block", pa.int64()), ("ids", pa.binary()), ("at", pa.int32()), ("seg", pa.string())])
            own = [batch.column(batch.schema.get_field_index(c)) for c in rest]
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.full(n, number)), lists, pa.nulls(n, pa.int32()), pa.nulls(n, none.type)], schema=schema)
            for k in range(0, len(known), 50_000):
                m = min(50_000, len(known) - k)
                yield pa.RecordBatch.from_arrays([*[pa.nulls(m, schema.field(c).type) for c in rest], pa.array(np.full(m, number)), pa.nulls(m, pa.binary()), pa.array(np.arange(k, k + m), pa.int32()), known.slice(k, m)], schema=schema)
            number += 1

    return run


def _compose(rest: list[str], link: np.dtype):
    """A block's documents from its segments' alignments; and in how many of them each id pair is linked."""

    def run(docs: pa.Table, segs: pa.Table) -> pa.Table:
        packed = segs.sort_by("at").column("packed").to_pylist()  # numbers 0, 1, ... without gaps
        links = np.frombuffer(b"".join([x for x in packed if x]), link)
        many = np.array([len(x or b"") for x in packed], np.int64) // link.itemsize
        fine = np.array([x is not None for x in packed], bool)
        del packed
        n_segs = max(1, len(many))
        owner = np.repeat(np.arange(len(many)), many)
        ids, size = unsqueezed(docs.column("ids"))
        n, own = len(docs), np.repeat(np.arange(len(docs)), size)
        good = (np.bincount(own, ~fine[ids], n) == 0 if len(ids) else np.ones(n, bool)) & (size > 0)
        ids, own, size = ids[good[own]], own[good[own]], size * good
        flags = [links["new"] & NEW_A > 0, links["new"] & NEW_B > 0]
        counted = [np.bincount(owner[f], minlength=n_segs) for f in (*flags, flags[0] & flags[1])]
        sums = [np.bincount(own, c[ids], n).astype(np.int64) for c in counted]
        text, length = written(links, owner, n_segs)
        begin, digests, at = np.cumsum(length) - length, [], 0
        for k, fit in zip(size.tolist(), good.tolist(), strict=True):
            mine = ids[at : at + k]
            digests.append(hashlib.sha256(memoryview(text[spread(begin[mine], length[mine])])[:-1]).hexdigest() if fit else "")
            at += k
        start = np.cumsum(many) - many
        pairs, local = np.unique(links["a"].astype(np.int64) << 32 | links["b"], return_inverse=True)
        # each document's distinct segments, then its distinct pairs, with how often they are there; some documents at a time
        width, ends = max(1, len(pairs)), np.cumsum(size)
        in_docs, steps, times, d = np.zeros(len(pairs), np.int64), [], [], 0
        while d < n:
            done = int(ends[d - 1]) if d else 0
            to = max(d + 1, int(np.searchsorted(ends, done + SLICE, side="right")))
            mine = slice(done, int(ends[to - 1]))
            key, often = np.unique((own[mine] - d) * n_segs + ids[mine], return_counts=True)
            doc, seg = key // n_segs, key % n_segs
            key = np.repeat(doc, many[seg]) * width + local[spread(start[seg], many[seg])]
            order = np.argsort(key, kind="stable")
            key, often = key[order], np.repeat(often, many[seg])[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            often = np.add.reduceat(often, first) if len(key) else often
            doc, pair = key[first] // width, key[first] % width
            in_docs += np.bincount(pair, minlength=len(pairs))
            upto = np.cumsum(np.bincount(doc, minlength=to - d)).tolist()
            for i, j in zip([0, *upto], upto, strict=False):
                steps.append(squeeze(np.diff(pair[i:j], prepend=0)))
                times.append(squeeze(often[i:j]))
            d = to
        here = np.flatnonzero(in_docs)
        m, block = len(here), docs.column("of").combine_chunks()
        none = pa.nulls(n, pa.int32())
        columns = [*[docs.column(c).combine_chunks() for c in rest], block, *[pa.array(s) for s in sums], pa.array(digests, pa.string()), pa.array(steps, pa.binary()), pa.array(times, pa.binary()), none, pa.nulls(n, pa.int64()), none]
        names = [*rest, "block", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "often", "at", "pair", "docs"]
        release()
        tail = [pa.nulls(m, c.type) for c in columns]
        tail[len(rest)] = pa.array(np.full(m, block[0].as_py() if n else 0), pa.int64())
        tail[-3:] = [pa.array(here, pa.int32()), pa.array(pairs[here], pa.int64()), pa.array(in_docs[here], pa.int32())]
        return pa.table([pa.chunked_array([c, t]) for c, t in zip(columns, tail, strict=True)], names)

    return run


def _finish(rest: list[str]):
    """A block's documents with the counts of its pairs."""

    def run(docs: pa.Table, pairs: pa.Table) -> pa.Table:
        at = pairs.column("at").to_numpy()
        count, best = (np.zeros(int(at.max(initial=-1)) + 1, np.int64) for _ in range(2))
        count[at], best[at] = pairs.column("count").to_numpy(), pairs.column("best").to_numpy()
        which, size = unsqueezed(docs.column("pairs"))
        often = unsqueezed(docs.column("often"))[0]
        upto = np.cumsum(size)
        steps = np.cumsum(which)  # each document's numbers are kept as steps from one to the next
        which = steps - np.repeat(np.concatenate([[0], steps])[upto - size], size)
        total = lambda x: np.diff(np.concatenate([[0], np.concatenate([[0], np.cumsum(x)])[upto]]))
        got = [total(often), total(often * best[which]) if len(which) else total(often), total(often * count[which]) if len(which) else total(often)]
        columns = [docs.column(c) for c in (*rest, "n_a", "n_b", "n_groups")]
        return pa.table([*columns, *[pa.chunked_array([pa.array(g, pa.int64())]) for g in got], docs.column("groups_sha256")], [*rest, *RESULTS])

    return run


def align_corpus(docs: DataFrame, a: str, b: bytes, *, text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """docs without the text, with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    a: the content of a tokenizers .json file (byte-level BPE). b: that of a sentencepiece .model file."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    held = spark.sparkContext.broadcast((a, b))  # the vocabularies' files
    rest = [c for c in docs.columns if c != text_col and c.lower() not in RESULTS]
    # names of our own, so that extra columns may be called anything
    inner = [f"own{k}" for k in range(len(rest))]
    plain = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(rest, inner, strict=True)], F.col(f"`{text_col}`").alias("text"))
    fields = [T.StructField(k, plain.schema[k].dataType) for k in inner]
    kind = lambda ddl: T.StructType([*fields, *T._parse_datatype_string(ddl).fields])
    pair = Pair(a, b)
    blocks = scratch.save(plain.mapInArrow(_cutter("text", inner, pair.breaks), kind("block long, ids binary, at int, seg string")), "zstd")
    # a segment's rows (one for each block) come one after the other in one task's stream, which aligns it once
    segs = blocks.where("at IS NOT NULL").select("seg", "block", "at").repartition("seg").sortWithinPartitions("seg")

    def tokenise(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        pair, last = Pair(*held.value), (None, None)
        for batch in batches:
            for part in shards((batch.slice(k, BATCH) for k in range(0, len(batch), BATCH)), "seg", BLOCK_BYTES // 4):
                coded = part.column(0).dictionary_encode()
                segments, first = coded.dictionary.to_pylist(), None
                if segments[0] == last[0]:
                    segments, first = segments[1:], last[1]
                packed = align(segments, pair)
                packed = packed if first is None else pa.concat_arrays([first, packed])
                last = (coded.dictionary[len(packed) - 1].as_py(), packed.slice(len(packed) - 1))
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), packed.take(coded.indices)], ["block", "at", "packed"])
        release()

    back = segs.mapInArrow(tokenise, "block long, at int, packed binary")
    whole = blocks.where("at IS NULL").select(*inner, F.col("block").alias("of"), "ids")
    composed = scratch.save(whole.groupBy("of").cogroup(back.groupBy("block")).applyInArrow(_compose(inner, pair.link), kind("block long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs binary, often binary, at int, pair long, docs int")), "zstd")
    scratch.drop(blocks)
    linked = composed.where("at IS NOT NULL").select("block", "at", "pair", "docs")
    counts = linked.groupBy("pair").agg(F.sum("docs").alias("count")).withColumn("a", F.shiftright("pair", 32))
    counts = scratch.save(counts)
    # a row for each id of A at most
    highest = F.broadcast(counts.groupBy("a").agg(F.max("count").alias("highest")))
    known = counts.join(highest, "a").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    back = linked.join(known, "pair").select("block", "at", "count", "best")
    whole = composed.where("at IS NULL").drop("at", "pair", "docs").withColumnRenamed("block", "of")
    out = whole.groupBy("of").cogroup(back.groupBy("block")).applyInArrow(_finish(inner), kind("n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"))
    return out.select(*[F.col(k).alias(c) for c, k in zip(rest, inner, strict=True)], *RESULTS)


def op11_alignment(spark: SparkSession, sf_dir: str, a: str | None = None, b: str | None = None) -> DataFrame:
    """a, b: paths of a tokenizers .json and a sentencepiece .model file; by default those of the public_tokenizers package."""
    if a is None or b is None:
        import public_tokenizers

        a, b = a or public_tokenizers.path("byte_bpe_50k.json"), b or public_tokenizers.path("piece_bpe_32k.model")
    return align_corpus(table(spark, sf_dir, "documents").select("doc_id", "text"), open(a, encoding="utf-8").read(), open(b, "rb").read())


def brute_force(texts: list, a: str, b: bytes) -> list[tuple]:
    """n_a, ... of texts encoded whole, token by token (for tests)."""
    pair = Pair(a, b)
    at = lambda t, i: bytes(t.data[t.start[i] : t.start[i] + t.size[i]])
    docs, linked = [], {}
    for text in texts:
        doc = None
        if text:
            whole = (" " + text).encode()
            ids = [pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)]
            parts = [[at(t, i) for i in x] for t, x in zip((pair.tokens, pair.pieces), ids, strict=True)]
            if b"".join(parts[0]) == whole == b"".join(parts[1]):
                ends = [np.cumsum([len(p) for p in x]).tolist() for x in parts]
                shared = sorted(set(ends[0]) & set(ends[1]))
                where = [[bisect.bisect_right(end, e) for e in shared] for end in ends]
                groups = ["|".join(",".join(map(str, x[low:high])) for x, low, high in zip(ids, (i, j), (p, q), strict=True)) for i, j, p, q in zip([0, *where[0]], [0, *where[1]], *where, strict=False)]
                links, j = [], 0
                for i, p, e in zip(ids[0], parts[0], ends[0], strict=True):
                    while j and ends[1][j - 1] > e - len(p):
                        j -= 1
                    while ends[1][j] <= e - len(p):
                        j += 1
                    k = j
                    while k < len(ids[1]) and ends[1][k] - len(parts[1][k]) < e:
                        links.append((i, ids[1][k]))
                        k += 1
                doc = (len(ids[0]), len(ids[1]), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest())
                for link in set(links):
                    linked[link] = linked.get(link, 0) + 1
        docs.append(doc)
    top = {}
    for (i, _), n in linked.items():
        top[i] = max(top.get(i, 0), n)
    return [(d[0], d[1], d[2], len(d[3]), sum(linked[x] == top[x[0]] for x in d[3]), sum(linked[x] for x in d[3]), d[4]) if d else (0, 0, 0, 0, 0, 0, "") for d in docs]
