"""Toxicity: a convolutional text classifier, trained in numpy.

A word's embedding is the sum of hashed rows: two by independent hashes of the word (words share both only if both hashes
collide), and one each by its first 4 and 6 bytes, which the forms of one stem share. Filters of several widths run over the words, each filter keeps its largest response (max pooling),
and a logistic layer weighs them. Rows that training never touched are set to zero. Embeddings start from smoothed class
log-odds.

Training uses at most ``MAX_ROWS`` labelled rows (half of them, where there are so many, of either class, the first by a hash of
the id) and at most ``MAX_WORDS`` words in all; both are parameters. Texts are used whole, and the words are filled up from the class that
has fewer of them so far, so that neither class crowds the other out. The thresholds are
then calibrated by language on all labelled rows, whose logits are counted by language, class and bins of 1 / ``BINS``: the language is
read off the text itself by its function words (the lang column is no input), and a group with fewer than ``MIN_GROUP`` rows of either
class takes the common threshold. A score is the logistic of the logit less its group's threshold, so 0.5 is the threshold everywhere.

Scoring: filters are linear in the embeddings, so every row's contribution to every filter position is computed once and
broadcast (a table of fixed size); a text then costs a few gathers for each word. It is a narrow pass over whole texts.

Defined results: null, empty and wordless texts score like a text of one unknown word. With no usable labels, or labels of one class only,
every text scores 0. A document with several labels counts as toxic if one says so; null labels are passed over.
Extra columns stay, but for one named score, which the result replaces; ``remove_toxic`` gives back all columns of its input
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Held, Scratch, bucket_of, fresh, mix64, shards, table, word_hashes, word_parts

ROWS_LOG2, PREFIXES = 16, (4, 6)
PARTS = 2 + len(PREFIXES)
DIM, FILTERS, WIDTHS = 8, 8, (1, 2, 3)
EPOCHS, MIN_STEPS, BATCH, RATE = 6, 300, 64, 0.02
MAX_ROWS, MAX_WORDS, MIN_GROUP = 6000, 2_500_000, 25
#: Bins to a unit of the logit, and where the outermost bins are.
BINS, FARTHEST = 64, 64
#: Function words by which a text's language group is told.
FUNCTION_WORDS = {
    "en": "the and of to in is that it with for",
    "fr": "le la les et de des un une est que",
    "de": "der die das und ist ein eine nicht zu den",
    "es": "el la los las y de que en un una",
}


def featurise(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words the embedding rows (parts x words) and the text; of the texts the language group."""
    words, heads, doc = word_parts(column, PREFIXES)
    shift = np.uint64(64 - ROWS_LOG2)
    rows = np.stack([(x >> shift).astype(np.uint16) for x in (words, mix64(words), *heads)])
    return rows, doc, language_groups(words, doc, len(column))


def language_groups(words: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Of each text the group whose function words it has most of (0: none)."""
    counts = np.zeros((len(FUNCTION_WORDS) + 1, n))
    counts[0] = 0.5
    for k, (_, listed) in enumerate(FUNCTION_WORDS.items(), 1):
        known, _ = word_hashes(pa.array([listed]))
        known = np.sort(known)
        at = np.minimum(np.searchsorted(known, words), len(known) - 1)
        counts[k] = np.bincount(doc[known[at] == words], minlength=n)
    return counts.argmax(0)


class Filters:
    """The trained network in the form that scores: what each embedding row adds to each filter at each of its positions."""

    def __init__(self, embeddings, weights, bias, out, out_bias, shifts):
        self.learned = embeddings, weights
        self.made = None
        self.bias, self.out, self.out_bias, self.shifts = bias, out, out_bias, shifts

    @property
    def tables(self) -> list:
        embeddings, weights = self.learned
        self.made = self.made or [[[(e @ w[o]).astype(np.float32) for o in range(len(w))] for w in weights] for e in embeddings]
        return self.made

    def __reduce__(self):
        """What travels is what was learned; the tables, six times as large, are made where they are first used."""
        return Filters, (*self.learned, self.bias, self.out, self.out_bias, self.shifts)

    def logits(self, rows: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """rows of the words of n texts in order; each text is followed by blanks, which add nothing."""
        pad = max(WIDTHS)
        place = np.arange(rows.shape[1]) + doc * pad
        size = rows.shape[1] + n * pad
        start = np.searchsorted(doc, np.arange(n)) + np.arange(n) * pad
        out, tables = np.full(n, float(self.out_bias)), self.tables
        for k, width in enumerate(WIDTHS):
            z = np.zeros((size, FILTERS), np.float32)
            for o in range(width):  # the word at a place is the o-th of the window that begins o places before
                ok = slice(None) if not len(place) or place[0] >= o else place >= o
                z[(place - o)[ok]] += sum(t[k][o][r[ok]] for t, r in zip(tables, rows, strict=True))
            pooled = np.maximum.reduceat(z, start, axis=0) if n else z
            out += np.maximum(pooled + self.bias[k], 0) @ self.out[k]
        return out

    def scores(self, rows: np.ndarray, doc: np.ndarray, groups: np.ndarray) -> np.ndarray:
        logit = self.logits(rows, doc, len(groups)) - self.shifts[groups]
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def fit(texts: list[np.ndarray], groups: np.ndarray, toxic: np.ndarray, seed: int = 5) -> Filters | None:
    """texts: arrays of embedding rows (parts x words); groups: their language groups. The thresholds are those of these texts."""
    if not len(texts) or toxic.min() == toxic.max():
        return None
    rng, y = np.random.default_rng(seed), toxic.astype(float)
    n_rows, pad = 1 << ROWS_LOG2, max(WIDTHS)
    pairs = texts
    # document frequencies of embedding rows by class, as log-odds
    e = []
    for h in range(PARTS):
        seen = np.zeros((2, n_rows))
        for p, t in zip(pairs, toxic, strict=True):
            seen[int(t), np.unique(p[h])] += 1
        odds = np.log((seen[1] + 1) / (y.sum() + 2)) - np.log((seen[0] + 1) / ((1 - y).sum() + 2))
        rows = rng.normal(0, 0.02, (n_rows, DIM))
        rows[:, 0] = np.where(seen.sum(0) >= 3, odds / 2, 0)
        e.append(rows)
    weights = [rng.normal(0, 0.1, (w, DIM, FILTERS)) for w in WIDTHS]
    for w in weights:
        w[0, 0, : FILTERS // 2] += 1.0
    bias = [np.zeros(FILTERS) - 0.5 for _ in WIDTHS]
    out = [np.full(FILTERS, 0.2) for _ in WIDTHS]
    out_bias = np.array(-1.0)
    params = [*e, *weights, *bias, *out, out_bias]
    mean = [np.zeros_like(p) for p in params]
    square = [np.zeros_like(p) for p in params]
    touched = [np.zeros(n_rows, bool) for _ in e]
    step = 0
    for _ in range(max(EPOCHS, min(80, MIN_STEPS * BATCH // len(texts)))):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            ids = order[at : at + BATCH]
            blank = np.full((PARTS, pad), -1)
            rows_of = np.concatenate([x for i in ids for x in (pairs[i].astype(np.int64), blank)], axis=1)
            start = np.cumsum([0] + [pairs[i].shape[1] + pad for i in ids])[:-1]
            x = sum(p[r] for p, r in zip(e, rows_of, strict=True))
            x[rows_of[0] < 0] = 0
            x = np.vstack([x, np.zeros((pad, DIM))])
            n, m = len(ids), rows_of.shape[1]
            pooled, where = [], []
            for k, w in enumerate(weights):
                z = sum(x[o : o + m] @ w[o] for o in range(len(w)))
                top = np.maximum.reduceat(z, start, axis=0)
                own = np.repeat(np.arange(n), np.diff(np.append(start, m)))
                hit = z == top[own]
                first = np.full((n, FILTERS), m)
                rows, cols = np.nonzero(hit)
                np.minimum.at(first, (own[rows], cols), rows)
                pooled.append(top + bias[k])
                where.append(first)
            active = [np.maximum(p, 0) for p in pooled]
            logit = out_bias + sum(p @ o for p, o in zip(active, out, strict=True))
            delta = (1 / (1 + np.exp(-np.clip(logit, -50, 50))) - y[ids]) / n
            grads = [np.zeros_like(p) for p in e], [], [], []
            gx = np.zeros_like(x)
            for k, w in enumerate(weights):
                back = delta[:, None] * out[k] * (pooled[k] > 0)
                grads[3].append(active[k].T @ delta)
                grads[2].append(back.sum(0))
                gw = np.zeros_like(w)
                for o in range(len(w)):
                    gw[o] = np.einsum("nfd,nf->df", x[where[k] + o], back)
                    np.add.at(gx, where[k] + o, back[:, :, None] * w[o].T)
                grads[1].append(gw)
            live = np.flatnonzero((rows_of[0] >= 0) & np.any(gx[:m] != 0, axis=1))
            for h, index in enumerate(rows_of):
                np.add.at(grads[0][h], index[live], gx[live])
                touched[h][index[live]] = True
            step += 1
            flat = [*grads[0], *grads[1], *grads[2], *grads[3], np.array(delta.sum())]
            for j, (p, g) in enumerate(zip(params, flat, strict=True)):
                sel = np.unique(rows_of[j][live]) if j < PARTS else ...
                mean[j][sel] = 0.9 * mean[j][sel] + 0.1 * g[sel]
                square[j][sel] = 0.99 * square[j][sel] + 0.01 * g[sel] ** 2
                p[sel] -= RATE * (mean[j][sel] / (1 - 0.9**step)) / (np.sqrt(square[j][sel] / (1 - 0.99**step)) + 1e-8)
    for h in range(PARTS):
        frequent = e[h][:, 0] != 0
        e[h][~(touched[h] | frequent)] = 0
    del mean, square, params, touched, grads, flat
    model = Filters(e, weights, bias, out, float(out_bias), np.zeros(len(FUNCTION_WORDS) + 1))
    logits = np.empty(len(texts))
    for at in range(0, len(texts), BATCH):
        part = texts[at : at + BATCH]
        logits[at : at + BATCH] = model.logits(np.concatenate(part, axis=1), np.repeat(np.arange(len(part)), [t.shape[1] for t in part]), len(part))
    model.shifts[:] = thresholds(groups, toxic, np.floor(logits * BINS), np.ones(len(texts)))
    model.made = None  # the driver, which trains, does not score documents
    return model


def thresholds(groups: np.ndarray, toxic: np.ndarray, bins: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of each language group the threshold, from counts n of rows by group, class and bin."""
    out = np.full(len(FUNCTION_WORDS) + 1, _threshold(toxic, bins, n))
    for g in range(len(out)):
        own = groups == g
        if min(n[own & toxic].sum(), n[own & ~toxic].sum()) >= MIN_GROUP:
            out[g] = _threshold(toxic[own], bins[own], n[own])
    return out


def _threshold(toxic: np.ndarray, bins: np.ndarray, n: np.ndarray) -> float:
    """The middle of the widest stretch between bins that gives the best F1."""
    low, at = np.unique(bins, return_inverse=True)
    bad, good = (np.bincount(at, n * c, len(low)) for c in (toxic, ~toxic))
    kept = bad.sum() - np.concatenate([[0], np.cumsum(bad)])  # toxic rows in the k-th bin or above
    false = good.sum() - np.concatenate([[0], np.cumsum(good)])
    f1 = 2 * kept / np.maximum(kept + false + bad.sum(), 1e-9)
    begin, end = np.append(low[0] + 1 - 2 * BINS, low + 1), np.append(low, low[-1] + 2 * BINS)
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    k = best[np.argmax((end - begin)[best])]
    return float(begin[k] + end[k]) / 2 / BINS


def fill(sizes: list[tuple], max_words: int) -> list:
    """Of rows (hash, doc_id, words, toxic) the ids to train on: in order of the hash, always from the class with fewer words so far."""
    queues = [sorted(r[:3] for r in sizes if bool(r[3]) == c)[::-1] for c in (False, True)]
    take, words, has = [], [0, 0], [False, False]
    while any(queues):
        c = min((c for c in (0, 1) if queues[c]), key=lambda c: words[c])
        _, doc_id, n = queues[c].pop()
        if sum(words) + n <= max_words or not has[c]:
            take.append(doc_id)
            words[c] += n
            has[c] = True
    return take


def train(docs: DataFrame, labels: DataFrame, *, max_rows: int = MAX_ROWS, max_words: int = MAX_WORDS, scratch: Scratch | None = None) -> Filters | None:
    """docs: doc_id, text. labels: doc_id, toxic; only rows to learn from."""
    scratch = scratch or Scratch(docs.sparkSession)
    marks = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    marks = marks.withColumn("h", F.xxhash64("doc_id"))
    chosen = [marks.where(c).orderBy("h", "doc_id").limit(max_rows // 2) for c in (F.col("toxic"), ~F.col("toxic"))]
    chosen = scratch.save(chosen[0].unionByName(chosen[1]))
    ids = {r["doc_id"]: (r["h"], r["toxic"]) for r in chosen.collect()}  # at most max_rows
    if not ids:
        return None

    def run(batches):
        for batch in shards(batches, "text", 1_000_000):
            rows, doc, groups = featurise(batch.column(1))
            cut = np.searchsorted(doc, np.arange(len(batch) + 1))
            packed = [rows[:, cut[i] : cut[i + 1]].tobytes() for i in range(len(batch))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(cut), pa.int64()), pa.array(groups, pa.int32()), pa.array(packed, pa.binary())], ["doc_id", "n_words", "grp", "rows"])

    # at most max_rows ids: small enough to send along with the scan, whatever the tables' sizes
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen.select("doc_id")), "doc_id")
    rows = scratch.save(rows.mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("grp", T.IntegerType()), T.StructField("rows", T.BinaryType())])).dropDuplicates(["doc_id"]))
    sizes = [(ids[r["doc_id"]][0], r["doc_id"], r["n_words"], ids[r["doc_id"]][1]) for r in rows.select("doc_id", "n_words").collect() if r["n_words"]]
    take = fill(sizes, max_words)
    if len(take) < len(sizes):
        rows = rows.where(F.col("doc_id").isin(take))
    got = [(*ids[r["doc_id"]], r["grp"], np.frombuffer(r["rows"], np.uint16).reshape(PARTS, -1)) for r in rows.where("n_words > 0").toLocalIterator()]
    got.sort(key=lambda r: (r[0], r[3].shape[1]))
    toxic = np.array([r[1] for r in got], bool)
    if not len(got) or toxic.all() or not toxic.any():
        return None
    model = fit([r[3] for r in got], np.array([r[2] for r in got]), toxic)
    model.shifts[:] = calibrate(docs, marks, model)
    return model


def calibrate(docs: DataFrame, marks: DataFrame, model: Filters) -> np.ndarray:
    """The thresholds by all labelled rows (marks: doc_id, toxic). Texts are scored where they are; only ids and bins are joined."""
    held = Held(docs.sparkSession, model)

    def run(batches):
        model = held.value
        for batch in shards(batches, "text", 1_000_000):
            rows, doc, groups = featurise(batch.column(1))
            bins = np.floor(np.clip(model.logits(rows, doc, len(batch)), -FARTHEST, FARTHEST) * BINS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(groups, pa.int32()), pa.array(bins, pa.int32())], ["doc_id", "grp", "bin"])

    rows = docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("grp", T.IntegerType()), T.StructField("bin", T.IntegerType())]))
    counts = rows.join(marks.select("doc_id", "toxic"), "doc_id").groupBy("grp", "toxic", "bin").count().collect()  # at most 2 * FARTHEST * BINS + 1 bins
    held.drop()
    groups, toxic, bins, n = (np.array(x) for x in zip(*counts, strict=True))
    return thresholds(groups, toxic.astype(bool), bins, n)


def score(docs: DataFrame, model: Filters | None, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a column of scores; one of that name is replaced."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != score_col])
    held = Held(docs.sparkSession, model)

    def run(batches):
        model = held.value
        for batch in shards(batches, text_col, 1_000_000):
            n = len(batch)
            out = model.scores(*featurise(batch.column(batch.schema.get_field_index(text_col)))) if model else np.zeros(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], schema=pa.schema([*batch.schema, pa.field(score_col, pa.float64())]))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))


def remove_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that the classifier scores at 0.5 or more.

    A row's own label has no part in its score: rows fall into two folds by their id, and each fold is judged by a classifier that learned
    from the other fold's labels. Null ids are of the first fold. A fold whose judge has no labels of both kinds is kept whole."""
    name, parts = fresh(docs, "toxic_score"), []
    fold = lambda c: F.coalesce(bucket_of(c, 2), F.lit(0))
    for k in (0, 1):
        model = train(docs, labels.where(fold("doc_id") == 1 - k))
        parts.append(score(docs.where(fold("doc_id") == k), model, score_col=name))
    return parts[0].unionByName(parts[1]).where(F.col(name) < 0.5).drop(name)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(bucket_of("doc_id") == 0, F.lit(False))
    model = train(docs, table(spark, sf_dir, "labels").where(~held_out).select("doc_id", "toxic"))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
