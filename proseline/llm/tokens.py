"""Token counts of a byte-level BPE tokenizer by rank-synchronous array merging.

Texts are split by the tokenizer's own pattern. Distinct pre-tokens of a shard lie side by side as one ragged numpy array
of symbols. In each round every sequence finds its lowest-ranked pair, and all sequences merge theirs at once (runs of
overlapping pairs from the left); finished sequences leave the array with their number of surviving symbols. A bounded
table of short pre-tokens carries counts from shard to shard.

The operator is narrow: one pass, no shuffle; a task holds one shard. The tokenizer file is read once on the driver and
broadcast (the vocabulary bounds its size).

Defined results: null and empty texts have 0 bytes and 0 tokens. Strings of added tokens inside a text count as one token, as
the library does by default. Texts of any length are counted whole. Rows are kept as they are, repeated ones too, and
so are extra columns, but for those with a result's name, which the result replaces.
"""

from __future__ import annotations

import json
from collections import ChainMap

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Held, shards, table, utf8

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The table that carries counts from shard to shard: at most twice so many pre-tokens, none of more than KEPT_CHARS characters.
KEPT, KEPT_CHARS = 300_000, 24
_NONE = np.int64(1) << 40


class RankMerger:
    """Counts the symbols that are left of byte strings."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("only plain byte-level BPE tokenizers can be counted")
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in spec["added_tokens"]):
            raise ValueError("added tokens that take in white space or whole words are not supported")
        self.added = [x["content"] for x in spec["added_tokens"]]
        # the printable characters that stand for the bytes in the file
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        hidden = [b for b in range(256) if b not in set(shown)]
        char = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
        vocab = model["vocab"]
        self.first = np.zeros(256, np.int64)
        for c, b in char.items():
            self.first[b] = vocab[c]
        self.base = np.int64(max(vocab.values()) + 1)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        key = np.array([vocab[x] * int(self.base) + vocab[y] for x, y in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank = key[order], order.astype(np.int64)
        self.made = np.array([vocab[x + y] for x, y in pairs], np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        want = left * self.base + right
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return np.where(self.key[at] == want, self.rank[at], _NONE)

    def count(self, pieces: list[bytes]) -> np.ndarray:
        size = np.array([len(p) for p in pieces], np.int64)
        out = size.copy()
        live = np.flatnonzero(size > 1)
        if not len(live):
            return out
        symbols = self.first[np.frombuffer(b"".join([pieces[i] for i in live]), np.uint8)]
        size = size[live]
        start = np.cumsum(size) - size
        rank = np.full(len(symbols), _NONE)
        rank[:-1] = self.ranks(symbols[:-1], symbols[1:])
        rank[start + size - 1] = _NONE
        while len(live):
            low = np.minimum.reduceat(rank, start)
            over = low == _NONE
            if over.any():
                out[live[over]] = size[over]
                keep = np.repeat(~over, size)
                symbols, rank, live, size, low = symbols[keep], rank[keep], live[~over], size[~over], low[~over]
                start = np.cumsum(size) - size
                if not len(live):
                    break
            at = np.flatnonzero(rank == np.repeat(low, size))
            # of neighbours that overlap (the same symbol again and again) every second one merges
            run = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1] + 1]))
            offset = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
            at = at[offset % 2 == 0]
            symbols[at] = self.made[rank[at]]
            rank[at] = rank[at + 1]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            seq = np.searchsorted(start, at, side="right") - 1
            size = size - np.bincount(seq, minlength=len(size))
            at = at - np.arange(len(at))
            symbols, rank = symbols[keep], rank[keep]
            start = np.cumsum(size) - size
            last = start + size - 1
            for p in (at, at[at > 0] - 1):  # pairs that changed: the new symbol's and the one before it
                p = p[p + 1 < len(symbols)]
                rank[p] = self.ranks(symbols[p], symbols[p + 1])
            rank[last] = _NONE
        return out


def count_tokens(docs: DataFrame, tokenizer: str, *, text_col: str = "text", limit: int = 1024) -> DataFrame:
    """docs without the text, with n_bytes, n_tokens and over_limit. tokenizer: path of a tokenizers .json file."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_bytes", "n_tokens", "over_limit")])
    held = Held(docs.sparkSession, RankMerger(tokenizer))
    rest = [f for f in docs.schema.fields if f.name != text_col]
    schema = T.StructType([*rest, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches):
        import regex

        merger = held.value
        split = regex.compile(PATTERN).findall
        added = regex.compile("|".join(map(regex.escape, sorted(merger.added, key=len, reverse=True)))) if merger.added else None
        kept: dict[str, int] = {}
        for batch in shards(batches, text_col):
            i = batch.schema.get_field_index(text_col)
            _, starts, ends = utf8(batch.column(i))
            tokens, extra = [], np.zeros(len(batch), np.int64)
            for k, text in enumerate(batch.column(i).to_pylist()):
                if not text:
                    tokens.append(())
                    continue
                if added and any(x in text for x in merger.added):
                    parts = added.split(text)
                    extra[k] = len(parts) - 1
                    tokens.append([t for p in parts for t in split(p)])
                else:
                    tokens.append(split(text))
            new = list(set().union(*tokens).difference(kept)) if tokens else []
            fresh = dict(zip(new, merger.count([t.encode() for t in new]).tolist(), strict=True))
            if len(kept) + len(fresh) < 2 * KEPT:
                long = {t: fresh.pop(t) for t in new if len(t) > KEPT_CHARS}
                kept |= fresh
                fresh = ChainMap(kept, long) if long else kept
            else:
                fresh |= {t: kept[t] for t in set().union(*tokens).intersection(kept)}
            counts = [sum(map(fresh.__getitem__, t)) for t in tokens]
            if len(kept) > KEPT:
                kept = {}
            columns = [c for c, f in zip(batch.columns, batch.schema, strict=True) if f.name != text_col]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(ends - starts, pa.int64()), pa.array(np.array(counts, np.int64) + extra, pa.int64())],
                schema=pa.schema([*[f for f in batch.schema if f.name != text_col], pa.field("n_bytes", pa.int64()), pa.field("n_tokens", pa.int64())]),
            )

    return docs.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)


def op9_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """tokenizer: path of a tokenizers .json file; by default the byte-level one of the public_tokenizers package."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer)
