"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts come from all learning rows, not a sample: each task adds up the n-grams of its shards in one table for
each language and hands over the non-zero cells; a grouped sum makes the totals. The log-probability matrix (features x
languages, at most ``MAX_LANGS`` languages, checked) is broadcast. Scoring gathers the matrix rows of a shard's n-grams, in slices
of at most ``CELLS`` matrix cells, and adds them up for each text, which is a sparse batch product in numpy. Neither pass shuffles texts.

Texts are lowered; whatever is no letter counts as one space-like symbol, and n-grams of such symbols alone are left out.

Defined results: a null text, or one without a letter, is ``und`` with score 0, and so is every text if nothing was learned.
The score is the posterior of the predicted language. Ties go to the language first in code-point order. Learning rows with a
null language or text are passed over. Extra columns stay, but for those named lang_pred or score, which the results replace;
``keep_wanted`` gives back all columns of its input whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Held, bucket_of, fresh, shards, table

FEATURES_LOG2 = 16
ORDERS = (1, 2, 3)
SMOOTHING = 0.1
MAX_LANGS, CELLS = 512, 2_000_000
#: The languages that a corpus keeps where nothing else is said.
WANTED = ("en",)


def letter_table() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def features(texts: list, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of a shard in the order of the texts, the text of each, and whether a text has a letter."""
    low = [(t or "").lower() for t in texts]
    size = np.array([len(t) for t in low], np.int64)
    code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters[code]
    own = np.repeat(np.arange(len(texts), dtype=np.int32), size)
    has = np.bincount(own[is_letter], minlength=len(texts)) > 0
    symbol = np.where(is_letter, code, np.uint32(1))
    grams, owners = [], []
    state = np.zeros(len(code), np.uint32)
    some = np.zeros(len(code), bool)
    for n in range(1, max(ORDERS) + 1):
        m = len(code) - n + 1
        if m <= 0:
            break
        state = (state[:m] ^ symbol[n - 1 :]) * np.uint32(0x9E3779B1)
        state ^= state >> np.uint32(15)
        some = some[:m] | is_letter[n - 1 :]
        if n in ORDERS:
            keep = some & (own[:m] == own[n - 1 :])
            grams.append(((state[keep] * np.uint32(0x85EBCA6B + 2 * n)) >> np.uint32(32 - FEATURES_LOG2)).astype(np.int64))
            owners.append(own[:m][keep])
    return grams, owners, has


def count_grams(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", fold: Column | None = None) -> dict[int, dict[str, np.ndarray]]:
    """For each fold (a small whole number; 0 where none is given) and language the n-gram counts and last the number of rows."""
    f = 1 << FEATURES_LOG2

    def run(batches):
        letters, total = letter_table(), {}
        for batch in shards(batches, "text", 1_000_000):
            langs = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            names = sorted(set(langs))
            index = np.array([names.index(x) for x in langs], np.int64)
            grams, owners, _ = features(batch.column(0).to_pylist(), letters)
            for name, k in zip(names, range(len(names)), strict=True):
                total.setdefault(name, np.zeros(f + 1, np.int64))[f] += int((index == k).sum())
            for g, own in zip(grams, owners, strict=True):
                counts = np.bincount(index[own] * f + g, minlength=len(names) * f).reshape(len(names), f)
                for k, name in enumerate(names):
                    total[name][:f] += counts[k]
            if len(total) > 64:
                yield from emit(total)
                total = {}
        yield from emit(total)

    def emit(total):
        for (name, part), counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(at), pa.int32()), pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], ["fold", "lang", "feature", "n"])

    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), (F.lit(0) if fold is None else fold).cast("int").alias("fold")).where("text IS NOT NULL AND lang IS NOT NULL")
    cells = rows.mapInArrow(run, "fold int, lang string, feature int, n long").groupBy("fold", "lang", "feature").agg(F.sum("n").alias("n"))
    found: dict[int, dict[str, np.ndarray]] = {}
    for part, lang, feats, ns in cells.groupBy("fold", "lang").agg(F.collect_list("feature"), F.collect_list("n")).toLocalIterator():
        row = found.setdefault(part, {}).setdefault(lang, np.zeros(f + 1))
        row[np.array(feats, np.int64)] = ns
        if len(found[part]) > MAX_LANGS:
            raise ValueError(f"more than {MAX_LANGS} languages: their matrix is not broadcast")
    return found


def model_of(matrix: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray]:
    """Languages in code-point order; log-probabilities, a row for each feature and last the priors."""
    f, names = 1 << FEATURES_LOG2, sorted(matrix)
    if not names:
        return [], np.zeros((f + 1, 0))
    counts = np.stack([matrix[n] for n in names], axis=1)
    out = np.log(counts[:f] + SMOOTHING) - np.log(counts[:f].sum(0) + SMOOTHING * f)
    return names, np.vstack([out, np.log(counts[f] / counts[f].sum())])


def train(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """The model of all rows of docs that have a text and a language."""
    return model_of(count_grams(docs, text_col=text_col, lang_col=lang_col).get(0, {}))


def add_rows(sums: np.ndarray, matrix: np.ndarray, g: np.ndarray, own: np.ndarray) -> None:
    """Adds to each text's sums the matrix rows of its n-grams (own: the text of each, in order), a bounded slice at a time."""
    step = max(1, CELLS // max(1, matrix.shape[1]))
    for at in range(0, len(g), step):
        o = own[at : at + step]
        first = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
        sums[o[first]] += np.add.reduceat(matrix[g[at : at + step]], first, axis=0)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], *, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """docs with a predicted language and its posterior; columns of those names are replaced."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in (pred_col, score_col)])
    held = Held(docs.sparkSession, model)
    schema = T.StructType([*docs.schema.fields, T.StructField(pred_col, T.StringType()), T.StructField(score_col, T.DoubleType())])

    def run(batches):
        names, matrix = held.value
        letters, f = letter_table(), 1 << FEATURES_LOG2
        for batch in shards(batches, text_col, 1_000_000):
            n = len(batch)
            sums = np.tile(matrix[f], (n, 1))
            grams, owners, has = features(batch.column(batch.schema.get_field_index(text_col)).to_pylist(), letters)
            for g, own in zip(grams, owners, strict=True):
                if names:
                    add_rows(sums, matrix, g, own)
            if names:
                best = sums.argmax(1)
                share = 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1)
            pred = [names[best[i]] if names and has[i] else "und" for i in range(n)]
            score = np.where(has, share, 0.0) if names else np.zeros(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], schema=pa.schema([*batch.schema, pa.field(pred_col, pa.string()), pa.field(score_col, pa.float64())]))

    return docs.mapInArrow(run, schema)


def keep_wanted(docs: DataFrame, *, id_col: str = "doc_id", wanted: tuple[str, ...] = WANTED, least: float = 0.5) -> DataFrame:
    """docs (with text and lang) whose predicted language is one of ``wanted`` with a posterior of ``least`` or more.

    A row's own label has no part in its prediction: labelled rows fall into two folds by their id, and each fold is judged by a
    model that learned from the other, and from nothing else: a language that stands in one fold only is not learned by its judge, and a
    fold whose judge has learned nothing is rejected. Null ids are of the first fold. Rejected are other languages, texts without a letter and nulls.
    """
    fold = F.coalesce(bucket_of(id_col, 2), F.lit(0)).cast("int")
    halves = count_grams(docs, fold=fold)
    teach = [halves.get(1, {}), halves.get(0, {})]  # fold 0 is judged by fold 1
    pred, score = fresh(docs, "lang_pred"), fresh(docs, "lang_score")
    parts = [predict(docs.where(fold == k), model_of(teach[k]), pred_col=pred, score_col=score) for k in (0, 1)]
    found = parts[0].unionByName(parts[1])
    return found.where(F.col(pred).isin(*wanted) & (F.col(score) >= least)).drop(pred, score)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(bucket_of("doc_id") == 0, F.lit(False))
    model = train(docs.where(~held_out))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
