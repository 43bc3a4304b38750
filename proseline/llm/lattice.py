"""Subword lattice likelihood: the probability of a text, summed over all segmentations.

The pieces are those of an existing byte-level vocabulary, of any length, as far as they can occur in lowered words (others would only
take probability away); all single bytes are among them, so every string has a segmentation. Their scores are the
vocabulary's own and are not trained. What public vocabulary files store are merge ranks (a .model file's scores are the ranks negated), not
probabilities; a rank r is taken for a probability by Zipf's law, 1 / (r + ``OFFSET``), normalised over the pieces.

A word's lattice has an edge for every piece at every place, and one edge for the whole word, whose score is learned: what is left
of the word's count after an absolute discount. The discounted mass is the weight of the subword paths:
P(w) = max(c - d, 0) / N + (d V / N) P_sub(w), where P_sub is the forward recursion in log space over the word with a leading space,
ended by an end-of-word symbol. The end of a document is a symbol of its own with its count over N, outside the discount (V is the number
of distinct words), so the probabilities of all words and the end add up to 1. Lattices don't cross white space, so a document's
marginal probability is the product over its words and its end.

Scale. Word counts are added up in each task before the shuffle; they are all that is learned, and grow with the corpus. Lattices are
computed once for each distinct word. Of the word table the ``HOT`` most frequent words (a bounded number, those of more than ``HOT_BYTES``
bytes by their SHA-256) are broadcast and settle most of a document's words where it is read; the rest is joined by word, a row for each
document and distinct word. A word in the join, however long, is none of the ``HOT`` most frequent, so it has fewer than one in ``HOT``
of all words, and no key of the join is hot.
A document's number is drawn once and written with its rows, so a repeated task can't mix documents up.

Defined results: null, empty and blank texts have one token, the end. Words of any length are scored whole. Without training
texts N is 0, words have only their subwords, and the base is uniform. Rows are scored one by one, repeated and null ids too. Extra
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MIX3, Held, Scratch, bucket_of, mix64, shards, table

OFFSET, WORD_END = 10.0, 0.3
HOT, HOT_BYTES, FLUSH = 200_000, 128, 400_000
#: Words are rated in lots of about so many bytes, so that many of one length stand side by side.
LOT = 2_000_000
#: The end of a document; no word can hold a line break.
END = b"\n"
_BITS = 18


class Pieces:
    """Pieces by length with log scores (natural). A piece of up to 8 bytes is the integer of its bytes; a longer one goes by a 64-bit
    hash that grows byte by byte from the integer of its first 8 (two strings share it with a probability of about 2^-64)."""

    def __init__(self, pieces: list[bytes]):
        self.keys, self.at, self.order = [], [], []
        start = 0
        for size in range(1, max(map(len, pieces), default=0) + 1):
            own = [p for p in pieces if len(p) == size]
            keys = self.key(own, size)
            order = np.argsort(keys)
            self.keys.append(keys[order])
            self.at.append(start)
            self.order += [own[i] for i in order]
            start += len(own)
        self.n = start
        self.some = [self._bits(keys) for keys in self.keys]
        self.heads = np.unique(self.key([p[:8] for p in pieces if len(p) > 8], 8))
        self.some_heads = self._bits(self.heads)

    @staticmethod
    def key(pieces: list[bytes], size: int) -> np.ndarray:
        body = np.frombuffer(b"".join(pieces), np.uint8).reshape(-1, size).astype(np.uint64)
        out = np.zeros(len(body), np.uint64)
        for k in range(size):
            out = (out << np.uint64(8)) | body[:, k] if k < 8 else mix64(out * MIX3 + body[:, k])
        return out

    @staticmethod
    def _spot(keys: np.ndarray) -> np.ndarray:
        return (mix64(keys) >> np.uint64(64 - _BITS)).astype(np.int64)

    def _bits(self, keys: np.ndarray) -> np.ndarray:
        bits = np.zeros(1 << _BITS, bool)
        bits[self._spot(keys)] = True
        return bits

    @classmethod
    def load(cls, path: str) -> tuple[Pieces, np.ndarray]:
        """From a file of base64 pieces and ranks; scores fall with the rank as in Zipf's law."""
        rank: dict[bytes, int] = {}
        for line in open(path, "rb"):
            piece, r = line.split()
            piece = base64.b64decode(piece)
            body = piece[1:] if piece[:1] == b" " else piece
            # single bytes, and pieces of lowered text without inner white space
            if len(piece) == 1 or (body and body.translate(None, b" \t\n\v\f\r") == body and body.lower() == body):
                rank[piece] = int(r)
        out = cls(list(rank))
        logs = np.array([-np.log(OFFSET + rank[p]) for p in out.order])
        return out, logs - np.log(np.exp(logs).sum())

    @staticmethod
    def _find(want: np.ndarray, keys: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the wanted keys are there, and where."""
        hit = np.flatnonzero(some[Pieces._spot(want)])
        at = np.minimum(np.searchsorted(keys, want[hit]), len(keys) - 1)
        same = keys[at] == want[hit]
        return hit[same], at[same]

    def edges(self, words: np.ndarray) -> list[np.ndarray | None]:
        """words: n x length bytes. For each piece length the piece (or -1) at every place, or None if there is none at any."""
        n, length = words.shape
        key, out = np.zeros(words.shape, np.uint64), []
        for k in range(min(8, len(self.keys), length)):
            m = length - k
            key = (key[:, :m] << np.uint64(8)) | words[:, k:].astype(np.uint64)
            found = np.full(key.size, -1, np.int64)
            if len(self.keys[k]):
                hit, at = self._find(key.reshape(-1), self.keys[k], self.some[k])
                found[hit] = at + self.at[k]
            out.append(found.reshape(key.shape))
        if length > 8 and len(self.heads):
            # beyond 8 bytes only places whose first 8 open a longer piece are followed
            live, _ = self._find(key.reshape(-1), self.heads, self.some_heads)
            row, place, key = live // key.shape[1], live % key.shape[1], key.reshape(-1)[live]
            for k in range(8, min(len(self.keys), length)):
                on = place + k < length
                row, place = row[on], place[on]
                key = mix64(key[on] * MIX3 + words[row, place + k].astype(np.uint64))
                hit, at = self._find(key, self.keys[k], self.some[k]) if len(self.keys[k]) and len(key) else (row[:0], row[:0])
                found = None
                if len(hit):
                    found = np.full((n, length - k), -1, np.int64)
                    found[row[hit], place[hit]] = at + self.at[k]
                out.append(found)
        return out


def _log_sum(parts: list[np.ndarray]) -> np.ndarray:
    if len(parts) == 1:
        return parts[0]
    x = np.stack(parts)
    top = x.max(0)
    safe = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - safe).sum(0)) + safe


def forward(pieces: Pieces, scores: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Log marginal of each row of words (without the end), over all its segmentations."""
    n, length = words.shape
    log = np.append(scores, -np.inf)
    edge = [None if i is None else log[i].T.copy() for i in pieces.edges(words)]
    alpha = np.full((length + 1, n), -np.inf)
    alpha[0] = 0
    for j in range(1, length + 1):
        alpha[j] = _log_sum([alpha[j - k - 1] + edge[k][j - k - 1] for k in range(min(j, len(edge))) if edge[k] is not None])
    return alpha[length]


def grouped(words: list[bytes], most: int = 400_000):
    """Words (each with a leading space) of one length as matrices of at most so many bytes, with their places in the list."""
    size = np.array([len(w) for w in words], np.int64)
    order = np.argsort(size, kind="stable")
    cut = np.flatnonzero(np.diff(size[order])) + 1
    for part in np.split(order, cut) if len(order) else ():
        length = int(size[part[0]]) + 1
        step = max(1, most // length)
        for at in range(0, len(part), step):
            ids = part[at : at + step]
            body = np.frombuffer(b"".join([b" " + words[i] for i in ids]), np.uint8).reshape(len(ids), length)
            yield ids, body


def split(text: bytes | None) -> list[bytes]:
    """Words between white space (space, 0x09-0x0D), A-Z lowered, of UTF-8 bytes."""
    return (text or b"").lower().split()


def count_words(docs: DataFrame) -> DataFrame:
    """word, c (in rows to learn from), a (in all rows) from rows of text, learn; END counts the documents."""

    def run(batches):
        counts: dict[bool, Counter] = {True: Counter(), False: Counter()}

        def emit():
            for learn, counter in counts.items():
                if counter:
                    n = pa.array(counter.values(), pa.int64())
                    zero = pa.array(np.zeros(len(counter), np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(counter.keys(), pa.binary()), n if learn else zero, n], ["word", "c", "a"])
                counter.clear()

        for batch in shards(batches, "text", 4_000_000):
            texts = batch.column(0).cast(pa.binary() if batch.column(0).type == pa.string() else pa.large_binary()).to_pylist()
            for text, learn in zip(texts, batch.column(1).to_pylist(), strict=True):
                counts[bool(learn)].update(split(text))
                counts[bool(learn)][END] += 1
            if len(counts[True]) + len(counts[False]) > FLUSH:
                yield from emit()
        yield from emit()

    return docs.select("text", "learn").mapInArrow(run, "word binary, c long, a long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("a").alias("a"))


def hot_key(word: bytes) -> bytes:
    """What stands for a word in the table of frequent ones: itself, or, if it is long, its digest after a line break (which no word holds)."""
    return word if len(word) <= HOT_BYTES else END + hashlib.sha256(word).digest()


def frequent(rated: DataFrame) -> dict[bytes, tuple]:
    """base, score, known of the HOT most frequent words, by their keys, and of the end."""
    key = F.when(F.octet_length("word") <= HOT_BYTES, F.col("word")).otherwise(F.concat(F.lit(END), F.unhex(F.sha2("word", 256))))
    short = rated.select(key.alias("key"), "a", "base", "score", "known")
    end = F.col("key") == F.lit(END)  # every document has it, whether it is among the most frequent or not
    rows = short.where(~end).orderBy(F.desc("a"), "key").limit(HOT).unionByName(short.where(end)).drop("a").toArrow()
    return {k: (b, s, n) for k, b, s, n in zip(*(rows.column(i).to_pylist() for i in range(4)), strict=True)}


class Model:
    """What scores a word: totals (tokens n, distinct tokens v, both with the end), discount, pieces and their scores."""

    def __init__(self, pieces, scores, n, v, once, twice):
        self.pieces, self.scores, self.n, self.v = pieces, scores, n, v
        self.words = max(0, v - 1)
        self.discount = float(np.clip(once / max(1, once + 2 * twice), 0.05, 0.95)) if n else 0.0

    def word_logs(self, words: list[bytes], c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each word, by the base and by the lattice."""
        base = np.log10((c + 0.5) / (self.n + 0.5 * (self.v + 1)))
        sub = np.full(len(words), -np.inf)
        for ids, body in grouped(words):
            sub[ids] = forward(self.pieces, self.scores, body) + np.log(WORD_END)
        if not self.n:
            return base, sub / np.log(10)
        with np.errstate(divide="ignore"):
            whole = np.log(np.maximum(c - self.discount, 0) / self.n)
            out = np.logaddexp(whole, np.log(self.discount * self.words / self.n) + sub)
            end = np.array([w == END for w in words], bool)
            out[end] = np.log(c[end] / self.n)
        return base, out / np.log(10)


def train(counts: DataFrame, vocabulary: str) -> Model:
    """counts: a saved table as from count_words. vocabulary: path of a file of base64 pieces and ranks."""
    is_word = F.col("word") != F.lit(END)
    stats = counts.where("c > 0").agg(F.sum("c"), F.count("*"), F.count_if(is_word & (F.col("c") == 1)), F.count_if(is_word & (F.col("c") == 2))).first()
    n, v, once, twice = (x or 0 for x in stats)
    pieces, scores = Pieces.load(vocabulary)
    return Model(pieces, scores + np.log(1 - WORD_END), n, v, once, twice)


def lots(batches):
    """Record batches (of words first) put together to about LOT bytes of words."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(0).nbytes
        if size >= LOT:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if sum(len(b) for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def score_texts(docs: DataFrame, learn: Column, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """id, learn, n_tokens, n_known, train_tokens, base_score, score: a row for each row of docs."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    counts = scratch.save(count_words(docs))
    model = train(counts, vocabulary)
    held = Held(spark, model)

    def rate(batches):
        for batch in lots(batches):
            words, c = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            base, score = held.value.word_logs(words, c)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base), pa.array(score), pa.array((c > 0).astype(np.int64)), batch.column(2)], ["word", "base", "score", "known", "a"])

    rated = scratch.save(counts.select("word", "c", "a").mapInArrow(rate, "word binary, base double, score double, known long, a long"))
    scratch.drop(counts)
    held_hot = Held(spark, frequent(rated))
    n_train = int(model.n)

    def run(batches):
        hot = held_hot.value
        names = ["rid", "id", "learn", "word", "n", "n_tokens", "known", "base", "score"]
        for batch in shards(batches, "text", 4_000_000):
            rids, texts = batch.column(0).to_pylist(), batch.column(3).cast(pa.binary() if batch.column(3).type == pa.string() else pa.large_binary()).to_pylist()
            heads, t_rid, t_word, t_n = [], [], [], []
            for rid, text in zip(rids, texts, strict=True):
                words = split(text)
                base, score, known = hot.get(END, (0.0, 0.0, 0))
                for word, n in Counter(words).items():
                    got = hot.get(hot_key(word))
                    if got is None:
                        t_rid.append(rid)
                        t_word.append(word)
                        t_n.append(n)
                    else:
                        base += n * got[0]
                        score += n * got[1]
                        known += n * got[2]
                heads.append((rid, len(words) + 1, known, base, score))
            rid, tokens, known, base, score = zip(*heads, strict=True) if heads else ([],) * 5
            m, k = len(heads), len(t_rid)
            yield pa.RecordBatch.from_arrays(
                [pa.array([*rid, *t_rid], pa.int64()), pa.concat_arrays([batch.column(1), pa.nulls(k, batch.column(1).type)]), pa.concat_arrays([batch.column(2), pa.nulls(k, pa.bool_())]), pa.array([*[None] * m, *t_word], pa.binary()), pa.array([*[0] * m, *t_n], pa.int64()), pa.array([*tokens, *[0] * k], pa.int64()), pa.array([*known, *[0] * k], pa.int64()), pa.array([*base, *[0.0] * k], pa.float64()), pa.array([*score, *[0.0] * k], pa.float64())],
                names,
            )

    # ids are drawn in this one evaluation and saved with what belongs to them
    schema = T.StructType([T.StructField("rid", T.LongType()), T.StructField("id", docs.schema["id"].dataType), T.StructField("learn", T.BooleanType()), T.StructField("word", T.BinaryType()), *(T.StructField(c, T.LongType()) for c in ("n", "n_tokens", "known")), *(T.StructField(c, T.DoubleType()) for c in ("base", "score"))])
    numbered = docs.select(F.monotonically_increasing_id().alias("rid"), "id", "learn", "text")
    parts = scratch.save(numbered.mapInArrow(run, schema))
    sums = ["n_tokens", "known", "base", "score"]
    tails = parts.where("word IS NOT NULL").select("rid", "word", "n").join(rated.select("word", "base", "score", F.col("known").alias("k")), "word")
    tails = tails.groupBy("rid").agg(F.sum(F.col("n") * F.col("k")).alias("known_"), F.sum(F.col("n") * F.col("base")).alias("base_"), F.sum(F.col("n") * F.col("score")).alias("score_"))
    heads = parts.where("word IS NULL").select("rid", "id", "learn", *sums)
    out = heads.join(tails, "rid", "left")
    both = lambda c: F.col(c) + F.coalesce(F.col(f"{c}_"), F.lit(0))
    return out.select("id", "learn", "n_tokens", both("known").cast("long").alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"), both("base").alias("base_score"), both("score").alias("score"))


def op5_lm_scores(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """vocabulary: path of a file of base64 pieces and ranks; by default the byte-level one of the public_tokenizers package."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents")
    learn = F.coalesce(bucket_of("doc_id") != 1, F.lit(True))
    return score_texts(docs, learn, vocabulary).select(F.col("id").alias("doc_id"), (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
