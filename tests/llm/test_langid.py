import zlib

from proseline.llm import langid
from tests.llm.helpers import docs, folder, real


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_held_out_accuracy_and_inputs(spark, tmp_path):
    d = real(spark, "documents")
    rows = langid.op8_language_id(spark, "/root/testdata/sf0.001").collect()
    lang = {r["doc_id"]: r["lang"] for r in d.collect()}
    assert len(rows) == len(lang) and all(r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(lang[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    # labels of held-out rows and the source are no inputs
    other = d.selectExpr("doc_id", "text", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 5 = 0 THEN 'xx' ELSE lang END AS lang", "'s' AS source", "n_chars")
    again = langid.op8_language_id(spark, folder(spark, tmp_path, documents=other)).collect()
    assert {(r["doc_id"], r["lang_pred"]) for r in again} == {(r["doc_id"], r["lang_pred"]) for r in rows}


def test_against_plain_bayes(spark):
    """The batch scores against log-probabilities added up one by one."""
    import numpy as np

    texts = ["the cat sat", "le chat noir", "la casa", "Ünïcode ñ", "a", None, "1 2 3", ""]
    df = docs(spark, texts).selectExpr("doc_id", "text", "CASE WHEN doc_id IN (0, 4) THEN 'en' WHEN doc_id = 1 THEN 'fr' WHEN doc_id = 2 THEN 'es' END AS lang")
    names, matrix = langid.train(df)
    assert names == ["en", "es", "fr"]
    got = {r["doc_id"]: r for r in langid.predict(df.select("doc_id", "text"), (names, matrix)).collect()}
    letters = langid.letter_table()
    for i, t in enumerate(texts):
        grams, _, has = langid.features([t], letters)
        if not has[0]:
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        total = matrix[-1].copy()
        for g in np.concatenate(grams):
            total += matrix[g]
        assert got[i]["lang_pred"] == names[int(total.argmax())]
        assert abs(got[i]["score"] - 1 / np.exp(total - total.max()).sum()) < 1e-9
    assert [got[i]["lang_pred"] for i in range(3)] == ["en", "fr", "es"]


def test_edges(spark):
    df = docs(spark, ["abc", None])
    nothing = langid.train(df.where("lang IS NULL"))
    assert {r["lang_pred"] for r in langid.predict(df, nothing).collect()} == {"und"}
    assert langid.predict(df.limit(0), nothing).count() == 0
    kept = langid.keep_wanted(docs(spark, ["plain words here", None, "...", "x " * 50_000, "plain words here"]))
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 3, 4]
    assert langid.keep_wanted(df, wanted=("xx",)).count() == 0
    assert langid.keep_wanted(df.limit(0)).count() == 0


def test_wanted_languages_stay(spark):
    """English documents stay and others go, whatever their labels say; columns with the results' names are untouched."""
    d = real(spark, "documents")
    wrong = d.selectExpr("doc_id", "text", "IF(doc_id % 20 = 7, IF(lang = 'en', 'fr', 'en'), lang) AS lang", "source", "n_chars", "'a' AS lang_pred", "'b' AS Score", "doc_id AS contamination")
    kept = langid.keep_wanted(wrong)
    assert kept.columns == wrong.columns
    lang = {r["doc_id"]: (r["lang"], len(r["text"] or "")) for r in d.collect()}
    rows = {r["doc_id"]: r for r in kept.collect()}
    long = {i for i, (_, n) in lang.items() if n > 200}
    english = {i for i in long if lang[i][0] == "en"}
    assert len(english - set(rows)) <= 0.02 * len(english) and len(set(rows) & (long - english)) <= 0.02 * len(long)
    assert all(r["lang_pred"] == "a" and r["Score"] == "b" and r["contamination"] == i for i, r in rows.items())
    replaced = langid.predict(wrong, langid.train(d))
    assert replaced.columns == ["doc_id", "text", "lang", "source", "n_chars", "contamination", "lang_pred", "score"]


def test_many_languages_in_slices(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    matrix, g, own = rng.normal(size=(64, 7)), rng.integers(0, 64, 1000), np.sort(rng.integers(0, 5, 1000))
    want, got = np.zeros((5, 7)), np.zeros((5, 7))
    np.add.at(want, own, matrix[g])
    monkeypatch.setattr(langid, "CELLS", 50)
    langid.add_rows(got, matrix, g, own)
    assert np.allclose(got, want)


def test_each_fold_has_its_own_judge(spark, monkeypatch):
    """One row of a rare language changes nothing for the others: no row is judged by a model that saw it."""
    from pyspark.sql import functions as F

    seen = []
    judge = langid.predict
    monkeypatch.setattr(langid, "predict", lambda docs, model, **k: seen.append((model[0], {r["doc_id"] for r in docs.select("doc_id").collect()})) or judge(docs, model, **k))
    d = real(spark, "documents").withColumn("lang", F.when(F.col("doc_id") == 7, "xx").otherwise(F.col("lang")))
    kept = {r["doc_id"] for r in langid.keep_wanted(d).collect()}
    assert sum("xx" in names for names, _ in seen) == 1 and all(7 not in ids for names, ids in seen if "xx" in names)
    plain = {r["doc_id"] for r in langid.keep_wanted(real(spark, "documents")).collect()}
    assert len(kept ^ plain) <= 3
