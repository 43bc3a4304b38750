"""Files that each hold one JSON array, read by many tasks.

A file's splits come from Spark's text reader, with the comma as line separator, so any store and any split size does. What a split begins
with (inside a string or not, how deep) follows from all splits before it: a first pass over the text gives for each split whether its quotes
are even in number and how its brackets change the depth in both cases; one row for each split goes to the driver, which adds them up. A second
pass cuts elements at the commas of depth 1. Elements within a split are done; those across splits are pieced together by where they begin.

Defined results: elements that don't fit the schema give nulls, as Spark's JSON functions do. Empty arrays and empty files have no rows. Text before the array's
bracket and after its end is passed over. A compressed file is one split. An element is held whole by one task, however long it is.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Workers need not have the package installed: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules["proseline"])

_PIECES = "path string, block long, part int, kind string, text string"


def structure(data: np.ndarray, inside: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Of JSON text that begins inside a string (1) or not (0) and at some depth: which characters stand outside strings, the change of depth at
    each, the depth after each, and whether the text ends inside a string."""
    at = np.arange(len(data))
    slash = data == ord("\\")
    plain = np.maximum.accumulate(np.where(slash, -1, at))  # the last character that is no backslash
    run = np.concatenate([[0], at[1:] - 1 - plain[:-1]]) if len(data) else at
    quote = (data == ord('"')) & (run % 2 == 0)
    state = (inside + np.cumsum(quote)) % 2
    outside = (state == 0) & ~quote
    step = np.where(outside, ((data == ord("[")) | (data == ord("{"))).astype(np.int64) - ((data == ord("]")) | (data == ord("}"))), 0)
    return outside, step, depth + np.cumsum(step), int(state[-1]) if len(data) else inside


def _texts(batches):
    """(path, split, text) of each batch's stretch of a split, with the commas put back."""
    for batch in batches:
        paths, blocks, values = (batch.column(k) for k in range(3))
        block = blocks.to_numpy()
        path = np.array(paths.to_pylist(), object)
        cut = [0, *(np.flatnonzero((block[1:] != block[:-1]) | (path[1:] != path[:-1])) + 1).tolist(), len(batch)] if len(batch) else [0]
        for a, b in zip(cut, cut[1:], strict=False):
            yield path[a], int(block[a]), ("".join([v + "," for v in values.slice(a, b - a).to_pylist()])).encode()


def _summaries(batches):
    sums: dict[tuple, list] = {}
    for path, block, text in _texts(batches):
        data, s = np.frombuffer(text, np.uint8), sums.setdefault((path, block), [0, 0, 0])
        changes, ends = [], 0
        for start in (0, 1):
            _, step, _, ends = structure(data, (start + s[0]) % 2, 0)
            changes.append(int(step.sum()))
        s[0], s[1], s[2] = (ends + 1) % 2, s[1] + changes[0], s[2] + changes[1]  # ends: for a start inside
    rows = [(*k, *v) for k, v in sums.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()])], ["path", "block", "odd", "d0", "d1"])


class _Elements:
    """Cuts one split's text, as it comes, into whole elements and the pieces at its ends."""

    def __init__(self, inside: int, depth: int):
        self.inside, self.depth, self.open, self.begun, self.kept = inside, depth, depth > 0, False, []

    def take(self, text: bytes) -> list[tuple[str, bytes]]:
        data = np.frombuffer(text, np.uint8)
        outside, step, level, self.inside = structure(data, self.inside, self.depth)
        self.depth = int(level[-1]) if len(data) else self.depth
        begins, ends = (step == 1) & (level == 1), (step == -1) & (level == 0)
        marks = np.flatnonzero(begins | ends | (outside & (data == ord(",")) & (level == 1)))
        out, last = [], 0
        for m in marks.tolist():
            if not begins[m] and self.open:
                out.append(("whole" if self.begun else "head", b"".join([*self.kept, text[last:m]])))
            self.kept, self.open, self.begun, last = [], not ends[m], not ends[m], m + 1
        if self.open:
            self.kept.append(text[last:])
        return out

    def end(self) -> list[tuple[str, bytes]]:
        return [("tail" if self.begun else "middle", b"".join(self.kept))] if self.open else []


def _cutter(starts: dict):
    def batch(rows: list) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["path", "block", "part", "kind", "text"])

    def run(batches):
        now, cutter, rows, part = None, None, [], 0
        for path, block, text in _texts(batches):
            if (path, block) != now:
                if cutter:
                    rows += [(*now, part, k, t.decode()) for k, t in cutter.end()]
                now, cutter, part = (path, block), _Elements(*starts[path, block]), 0
            for kind, piece in cutter.take(text):
                if kind == "head" or piece.strip():
                    rows.append((path, block, part, kind, piece.decode()))
                part += 1
            if len(rows) > 10_000:
                yield batch(rows)
                rows = []
        if cutter:
            rows += [(*now, part, k, t.decode()) for k, t in cutter.end()]
        yield batch(rows)

    return run


def array_elements(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): the elements of JSON arrays, as they are written, in no order."""
    texts = spark.read.option("lineSep", ",").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    starts: dict[tuple, tuple] = {}
    now, inside, depth = None, 0, 0
    for r in sorted(texts.mapInArrow(_summaries, "path string, block long, odd long, d0 long, d1 long").collect()):  # a row for each split
        if r["path"] != now:
            now, inside, depth = r["path"], 0, 0
        starts[now, r["block"]] = (inside, depth)
        depth += r["d1"] if inside else r["d0"]
        inside = (inside + r["odd"]) % 2
    pieces = texts.mapInArrow(_cutter(starts), _PIECES)
    # at most two for each split
    order = Window.partitionBy("path").orderBy("block", "part")
    some = pieces.where("kind <> 'whole'").withColumn("origin", F.last(F.when(F.col("kind") == "tail", F.col("block")), True).over(order))
    joined = some.groupBy("path", "origin").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "part", "text"))), lambda x: x["text"]), "").alias("text"))
    return pieces.where("kind = 'whole'").select("path", "text").unionByName(joined.select("path", "text")).where(F.trim("text") != "")


def read_arrays(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The elements of JSON arrays as rows of a schema."""
    return array_elements(spark, path).select(F.from_json("text", schema).alias("row")).select("row.*")
