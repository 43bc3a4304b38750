import pytest

from proseline.llm.decontaminate import brute_force, decontaminate, find_contamination, op1_decontamination
from proseline.llm.registry import ORACLE_SQL
from tests.conftest import compare
from tests.llm.helpers import docs, folder, real

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
ITEMS = [(1, ITEM), (2, "Short one"), (3, None), (4, ""), (10, ITEM.upper()), (5, "ha " * 15), (6, "!!! ..."), (7, "über Straße")]
TEXTS = [
    None, "", "...", ITEM, f"x {ITEM} y", "ALPHA, beta; gamma delta epsilon zeta eta theta iota kappa tail", "alpha beta gamma delta", "a short   ONE here short one",
    "ha " * 40, "ha " * 9, "ha " * 10, "the über straße", "über Straße", "x " * 30_000 + ITEM, ITEM, ITEM[:-3],
]


def test_sql(spark):
    compare(spark, "op1", op1_decontamination, ORACLE_SQL["op1_decontamination"])


@pytest.mark.parametrize("block_words", [2_000_000, 13])
def test_brute_force(spark, tmp_path, block_words):
    bench = spark.createDataFrame(ITEMS, "item_id int, text string")
    found = find_contamination(docs(spark, TEXTS), bench, block_words=block_words)
    rows = {r["doc_id"]: r["contamination"] for r in found.collect()}
    want = brute_force(TEXTS, ITEMS)
    for i, (n_words, n_hit, n_items, _, _) in enumerate(want):
        bits = sum(bin(b).count("1") for b in rows[i]["hits"])
        assert (rows[i]["n_words"], bits, len(rows[i]["items"])) == (n_words, n_hit, n_items), TEXTS[i]
    if block_words > 100:
        assert rows[3]["longest_match"] == 12 and rows[8]["longest_match"] == 15
        sf = folder(spark, tmp_path, documents=docs(spark, TEXTS), benchmark=bench)
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in op1_decontamination(spark, sf).collect()}
        assert got == dict(enumerate(want))


def test_edges(spark):
    bench = spark.createDataFrame(ITEMS, "item_id int, text string")
    kept = decontaminate(docs(spark, TEXTS), bench)
    assert kept.columns == docs(spark, TEXTS).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, w in enumerate(brute_force(TEXTS, ITEMS)) if not w[4]]
    assert decontaminate(docs(spark, TEXTS).limit(0), bench).count() == 0
    assert decontaminate(docs(spark, TEXTS), bench.limit(0)).count() == len(TEXTS)
    clash = docs(spark, TEXTS).withColumnRenamed("lang", "contamination")
    assert sorted(r["doc_id"] for r in decontaminate(clash, bench).where("contamination = 'en'").collect()) == sorted(r["doc_id"] for r in kept.collect())
    assert find_contamination(clash, bench).select("contamination.n_words").count() == len(TEXTS)


def test_real_documents(spark):
    d, b = real(spark, "documents").toPandas(), real(spark, "benchmark").toPandas()
    want = brute_force(d.text.tolist(), list(zip(b.item_id, b.text, strict=True)))
    got = {r["doc_id"]: r for r in op1_decontamination(spark, "/root/testdata/sf0.001").collect()}
    assert [got[i]["n_hit"] for i in d.doc_id] == [w[1] for w in want]
