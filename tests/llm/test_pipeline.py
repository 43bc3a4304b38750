
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import docs, folder, real
from tests.llm.test_neardup import brute as near
from tests.llm.test_toxicity import corpus


def labelled(spark, texts, foreign):
    return docs(spark, texts).withColumn("lang", F.when(F.col("doc_id").isin(list(foreign)), "fr").otherwise(F.col("lang")))


def test_planted_cases(spark, tmp_path):
    texts, toxic = corpus(500)
    item = " ".join(f"item{i}" for i in range(14))
    clean = [i for i, t in enumerate(toxic) if not t and len(texts[i].split()) > 60]
    copy, leak, blank = len(texts), len(texts) + 1, len(texts) + 2
    texts += [texts[clean[0]].upper(), texts[clean[1]] + " " + item, "123 456"]
    french = [r["text"] for r in real(spark, "documents").where("lang = 'fr' AND length(text) > 200").collect()]
    foreign = range(len(texts), len(texts) + len(french))
    texts += french
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, item)], "item_id int, text string")
    sf = folder(spark, tmp_path, documents=labelled(spark, texts, foreign), labels=labels, benchmark=bench)
    rows = labelled(spark, texts, foreign)
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, sf)
        if name != "mixing":
            assert out.columns == docs(spark, ["a"]).columns
        out.write.parquet(f"{tmp_path}/{name}")
        rows = spark.read.parquet(f"{tmp_path}/{name}")
        left[name] = {r["doc_id"] for r in rows.select("doc_id").collect()}
    gone = set(range(len(texts))) - left["toxicity"]
    assert len(gone & {i for i, t in enumerate(toxic) if t}) >= 0.9 * sum(toxic) and len(gone & set(clean)) <= 2
    assert left["toxicity"] - left["language_id"] <= {blank} | set(foreign)
    assert len(left["language_id"] & set(foreign)) <= 1 and len(left["toxicity"] & set(foreign)) > 15
    assert copy not in left["near_duplicates"]
    ids = sorted(left["language_id"])
    root = near([texts[i] for i in ids])
    assert left["near_duplicates"] == {i for k, i in enumerate(ids) if root[k] == k}
    assert left["near_duplicates"] - left["decontamination"] == {leak} & left["near_duplicates"]
    assert left["mixing"] <= left["decontamination"] and len(left["mixing"]) > 0.5 * len(left["decontamination"])
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()} == left["mixing"]


def test_empty_tables(spark, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id int, text string")
    sf = folder(spark, tmp_path, documents=docs(spark, ["a"]).limit(0), labels=labels, benchmark=bench)
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_clashing_columns_and_nulls(spark, tmp_path):
    """Extra columns named like the operators' results come through the first four stages; nulls, repeats and ties don't crash."""
    texts, toxic = corpus(300)
    texts += [None, "", texts[0], texts[0], "one two three"]
    labels = spark.createDataFrame([*((i, 1, t) for i, t in enumerate(toxic)), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, None), (None, "x y z")], "item_id int, text string")
    rows = docs(spark, texts)
    rows = rows.unionByName(rows.limit(3)).unionByName(rows.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    extra = {"score": "1", "lang_pred": "2", "Contamination": "3", "component_id": "4", "kept": "5", "size": "6", "target": "7", "root": "8", "toxic": "9"}
    rows = rows.withColumns({k: F.lit(v) for k, v in extra.items()})
    sf = folder(spark, tmp_path, documents=rows, labels=labels, benchmark=bench)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, sf)
        rows.write.parquet(f"{tmp_path}/c_{name}")
        rows = spark.read.parquet(f"{tmp_path}/c_{name}")
        assert rows.columns == [*docs(spark, ["a"]).columns, *extra] and rows.count() > 200
        assert rows.where(" OR ".join(f"{k} <> '{v}'" for k, v in extra.items())).count() == 0
    assert corpus_pipeline.run(spark, sf).count() > 200
