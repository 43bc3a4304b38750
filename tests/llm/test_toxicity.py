import random
import zlib

import numpy as np
import pyarrow as pa

from proseline.llm import toxicity
from tests.llm.helpers import docs, folder


def corpus(n=700, seed=2):
    rng = random.Random(seed)
    texts, toxic = [], []
    for i in range(n):
        lang = ["the of and to is", "der die und ist das"][i % 2].split()
        words = [rng.choice(lang) if rng.random() < 0.3 else f"w{rng.randrange(3000)}" for _ in range(rng.randrange(5, 150))]
        bad = rng.random() < 0.2
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["nasty", "rotten", f"grimbl{rng.randrange(10**6)}"]))
        texts.append(" ".join(words))
        toxic.append(int(bad))
    return texts, toxic


def tables(spark, tmp_path, texts, toxic):
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int")
    return folder(spark, tmp_path, documents=docs(spark, texts), labels=labels)


def test_held_out(spark, tmp_path):
    texts, toxic = corpus()
    rows = toxicity.op10_toxicity(spark, tables(spark, tmp_path, texts, toxic)).collect()
    assert len(rows) == len(texts)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    right = sum(r["predicted"] == toxic[r["doc_id"]] for r in held)
    caught = sum(r["predicted"] for r in held if toxic[r["doc_id"]]) / sum(toxic[r["doc_id"]] for r in held)
    assert right >= 0.95 * len(held) and caught >= 0.85
    # labels of held-out rows and the documents' other columns are no inputs
    flipped = [1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t for i, t in enumerate(toxic)]
    sf = tables(spark, tmp_path, texts, flipped)
    docs(spark, texts).selectExpr("doc_id", "text", "'xx' AS lang", "NULL AS source", "n_chars").selectExpr("doc_id", "text", "lang", "CAST(source AS STRING) AS source", "n_chars").write.mode("overwrite").parquet(f"{sf}/documents.parquet")
    again = {r["doc_id"]: r["score"] for r in toxicity.op10_toxicity(spark, sf).collect()}
    assert max(abs(again[r["doc_id"]] - r["score"]) for r in rows) < 1e-3  # training repeats up to rounding


def test_filters_against_plain_convolution():
    texts, toxic = corpus(120, 3)
    texts += ["", "one"]
    column = pa.array(texts)
    rows, doc, groups = toxicity.featurise(column)
    parts = [rows[:, doc == i] for i in range(len(toxic))]
    model = toxicity.fit(parts, groups[: len(toxic)], np.array(toxic, bool))
    got = model.logits(rows, doc, len(texts))
    for i in range(len(texts)):
        own, total = rows[:, doc == i].astype(int), model.out_bias
        n = own.shape[1]
        for k, width in enumerate(toxicity.WIDTHS):
            z = np.zeros((n + max(toxicity.WIDTHS), toxicity.FILTERS))
            for at in range(len(z)):
                for o in range(width):
                    if at + o < n:
                        z[at] += sum(model.tables[p][k][o][own[p, at + o]] for p in range(toxicity.PARTS))
            total += np.maximum(z.max(0) + model.bias[k], 0) @ model.out[k]
        assert abs(total - got[i]) < 1e-3


def test_edges(spark, tmp_path):
    texts = [None, "", "...", "a b", "x " * 40_000, "a b"]
    one_class = tables(spark, tmp_path, texts, [0] * len(texts))
    assert {r["score"] for r in toxicity.op10_toxicity(spark, one_class).collect()} == {0.0}
    labels = spark.createDataFrame([(3, None), (None, 1), (4, 0), (5, 1), (5, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs(spark, texts), labels)
    assert model is not None and toxicity.score(docs(spark, texts), model).count() == len(texts)
    assert toxicity.train(docs(spark, texts), labels.limit(0)) is None
    assert toxicity.score(docs(spark, texts).limit(0), model).count() == 0
    assert toxicity.remove_toxic(docs(spark, ["clean"]), labels.limit(0)).columns == docs(spark, ["a"]).columns


def test_bounds(spark):
    texts, toxic = corpus(200, 4)
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    assert toxicity.train(docs(spark, texts), labels, max_rows=40, max_words=500) is not None


def test_rare_class_keeps_its_words():
    rng = random.Random(6)
    size = lambda: max(1, int(rng.lognormvariate(7, 0.8)))
    common, rare = [(i, f"c{i}", size(), False) for i in range(3000)], [(10 * i, f"r{i}", size(), True) for i in range(3000)]
    n = {r[1]: r[2] for r in common + rare}
    take = toxicity.fill(common + rare, 2_500_000)
    words = [sum(n[x] for x in take if x[0] == c) for c in "cr"]
    assert sum(words) <= 2_500_000 and min(words) >= 1_200_000
    # a class that has few words leaves the rest to the other
    take = toxicity.fill(common + rare[:10], 2_500_000)
    assert {r[1] for r in rare[:10]} <= set(take) and sum(n[x] for x in take) > 2_400_000
    assert toxicity.fill([(0, "a", 9, False), (1, "b", 9, True)], 5) == ["a", "b"]


def test_thresholds_by_all_labelled_rows(spark):
    texts, toxic = corpus(600, 7)
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    model = toxicity.train(docs(spark, texts), labels, max_rows=40)
    rows, doc, groups = toxicity.featurise(pa.array(texts))
    logits, toxic = model.logits(rows, doc, len(texts)), np.array(toxic, bool)
    f1 = lambda own, t: 2 * (toxic & own & (logits >= t)).sum() / max(1, (own & (logits >= t)).sum() + (toxic & own).sum())
    for g in range(len(model.shifts)):
        own = groups == g
        if min((own & toxic).sum(), (own & ~toxic).sum()) < toxicity.MIN_GROUP:
            own = groups >= 0
        best = max(f1(own, t) for t in logits[own])
        assert f1(own, model.shifts[g]) >= best - 0.02


def test_removed_by_the_other_folds_labels(spark, monkeypatch):
    """No row is scored by a classifier that learned from its label, and most toxic rows still go."""
    from proseline.llm import toxicity
    from proseline.llm.common import table

    data = "/root/testdata/sf0.01"
    d, labels = table(spark, data, "documents"), table(spark, data, "labels").select("doc_id", "toxic")
    learned, judged = [], []
    train, score = toxicity.train, toxicity.score
    monkeypatch.setattr(toxicity, "train", lambda docs, marks, **k: learned.append({r["doc_id"] for r in marks.collect()}) or train(docs, marks, **k))
    monkeypatch.setattr(toxicity, "score", lambda docs, model, **k: judged.append({r["doc_id"] for r in docs.select("doc_id").collect()}) or score(docs, model, **k))
    kept = {r["doc_id"] for r in toxicity.remove_toxic(d, labels).select("doc_id").collect()}
    assert len(learned) == len(judged) == 2 and not any(a & b for a, b in zip(learned, judged, strict=True))
    toxic = {r["doc_id"] for r in labels.where("toxic = 1").collect()}
    clean = {r["doc_id"] for r in labels.where("toxic = 0").collect()}
    assert len(clean - kept) <= 0.05 * len(clean) and len(toxic - kept) >= 0.6 * len(toxic), (len(clean - kept), len(clean), len(toxic - kept), len(toxic))


def test_a_trained_model_keeps_no_tables_on_the_driver():
    """They are made where texts are scored, from what was learned, and do not travel."""
    import pickle

    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 1 << toxicity.ROWS_LOG2, (toxicity.PARTS, 20)).astype(np.uint16) for _ in range(40)]
    model = toxicity.fit(texts, np.zeros(40, int), np.arange(40) % 2 == 0)
    assert model.made is None
    sent = pickle.loads(pickle.dumps(model))
    of = lambda m: m.logits(texts[0], np.zeros(20, int), 1)[0]
    assert sent.made is None and of(sent) == of(model) and sent.made is not None
