import math
import re
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from proseline.functions import lazy as Z
from proseline.functions import metrics as M
from proseline.functions import text as T
from proseline.functions.score import score

ODD = ["élève naïve", "a b", "x\r\ny", "p q", "m\u001cn", "“curly” ‘quotes’", "🙂 emoji 🙂", "İstanbul", "", " \n ", None, "word"]


def run(spark, texts, column):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", column(F.col("t")).alias("v")).collect()
    return [r["v"] for r in sorted(rows, key=lambda r: r["i"])]


def test_tokenisers_follow_python(spark):
    texts = [t for t in ODD if t is not None]
    assert run(spark, texts, T.words) == [t.split() for t in texts]
    assert run(spark, texts, T.strip) == [t.strip() for t in texts]
    assert run(spark, texts, T.alpha_words) == [re.findall("[a-zA-Z]+", t) for t in texts]
    assert run(spark, texts[:7], T.lower_words) == [re.findall(r"\b\w+\b", t.lower()) for t in texts[:7]]
    assert run(spark, ["A b. C! d? ", "x"], T.sentences) == [["A b", "C", "d"], ["x"]]
    assert run(spark, ['He said "go." Then left. v1.5 ok', "x"], T.closed_sentences) == [['He said "go', "Then left", "v1.5 ok"], ["x"]]
    assert run(spark, ["a\n\nb\n \nc", " "], T.paragraphs) == [["a", "b", "c"], [" "]]


def spec_repetition(t):
    w = t.split()
    if len(w) <= 1:
        return 0.0, 0.0, 0.0, 0.0
    rate = lambda n: sum(c > 1 for c in Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)).values()) / max(1, len(w) - n + 1)
    return rate(1), rate(2), rate(3), sum(a == b for a, b in zip(w, w[1:], strict=False)) / (len(w) - 1)


VOCABULARY = st.lists(st.sampled_from("she felt Cold. the sea, wave! wave “quiet” again? *bright* — and\n\n then".split(" ")), max_size=80).map(" ".join)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(VOCABULARY, min_size=10, max_size=20))
def test_properties(spark, texts):
    for text, r in zip(texts, run(spark, texts, M.repetition), strict=True):
        got = (r["token_repetition_rate"], r["bigram_repetition_rate"], r["trigram_repetition_rate"], r["consecutive_repetition_score"])
        assert all(math.isclose(a, b, abs_tol=1e-12) for a, b in zip(got, spec_repetition(text), strict=True)), text
    for p in run(spark, texts, M.prose):
        assert all(0 <= v <= 1 for v in p.asDict().values())


def test_windows_and_thresholds(spark):
    block = " ".join(f"w{i}" for i in range(30))
    r = run(spark, [f"{block} {block}", " ".join(f"w{i}" for i in range(59)), block], M.repetition)
    assert [x["sequence_repetition_score"] for x in r] == [1 / 31, 0.0, 0.0]
    c = run(spark, ["a b. a b. a b.", "a. a b c d e f g h. a b.", None, ""], M.coherence)
    assert c[0]["coherence_score"] == 0.3 and c[0]["sentence_length_variation"] == 0 and c[2]["coherence_score"] == 0 == c[3]["sentence_count"]
    e = run(spark, ["*a* x", "*a* *b c* *d*", "**bold** x", "*a b c d*"], M.emphasis_penalty)
    assert [round(x, 9) for x in e] == [0.15, 0.44, 0.0, 0.0]
    few = "She felt cold. She knew it. She saw. "
    p = run(spark, [few, few * 3], M.prose)
    assert p[0]["sentence_start_monotony"] == 0 and p[1]["sentence_start_monotony"] == 1.0 and p[1]["telling_verb_density"] > 0


# text, index of the standard regex, hits
REGEX_CASES = [
    ("very very very good", 0, 1), ("very very good", 0, 0), ("wait.... no", 1, 1), ("so... and then... no", 2, 1), ("no!!!", 3, 1), ("no!!", 3, 0),
    ("eyes of steel", 4, 1), ("he whispered and growled", 5, 2), ("She ran. She hid. She won", 6, 1), ("She ran. He hid. She won", 6, 0),
    ("slowly turned", 7, 1), ("tasted like ash and regret", 8, 1), ("Not a cat. Not a dog.", 9, 1), ("a cat and a dog", 9, 0),
]


def test_lazy_patterns(spark):
    for text, k, n in REGEX_CASES:
        r = run(spark, [text], lambda t, k=k: Z.lazy(t, Z.PatternSet((), (Z.STANDARD_REGEXES[k],))))[0]
        assert r["lazy_pattern_count"] == n, (text, k)
    r = run(spark, ["Hue and hueless HUE", None, ""], lambda t: Z.lazy(t, Z.PatternSet(("hue", "hue"), ())))
    assert r[0]["lazy_pattern_count"] == 6 and [x["n"] for x in r[0]["lazy_patterns_found"]] == [3, 3]
    assert r[0]["lazy_score"] == 1 - 1 / (1 + (6 / 0.04 - 0.3) / 2) and r[1]["lazy_pattern_count"] == 0


def test_pattern_files(tmp_path):
    f = tmp_path / "p.yaml"
    f.write_text("literal_strings: [a, b, a]\nregex_patterns: ['x+']\n")
    assert Z.load_patterns(str(f)) == Z.PatternSet(("a", "b", "a"), ("x+",))
    f.write_text("literal_strings: []\n")
    assert Z.load_patterns(str(f)) == Z.PatternSet() == Z.load_patterns(str(tmp_path / "none.yaml"))
    assert Z.override(Z.PatternSet(), legacy=["q"]) == Z.PatternSet(("q",), ())


def test_score_schema_and_empty_texts(spark):
    df = score(spark.createDataFrame([(1, None), (2, ""), (3, "A fine day. It rained.")], "id int, text string"))
    rows = {r["id"]: r for r in df.collect()}
    for k in (1, 2):
        assert rows[k]["quality_score"] == 0 and rows[k]["lint_score"] == 50 and rows[k]["lint_band"] == "unknown"
    assert rows[3]["quality_score"] > 0 and rows[3]["lint_band"] == "clean"


def test_scoring_is_narrow_and_pruned(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = score(df).select("doc_id", "coherence_score")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "slop" not in plan and "tapestry" not in plan


def test_cleaning(spark):
    texts = ["<think>a</think> b [THINK]c[/THINK] d <think>e", "plain", "<think>x"]
    assert run(spark, texts, T.strip_thinking) == ["b d", "plain", ""]
    assert run(spark, ["<think>a</think> b [THINK]c"], lambda t: T.strip_thinking(t, brackets=False)) == ["b [THINK]c"]
    assert run(spark, ["Hello, World!  x"], T.preprocess) == ["hello world x"]
    assert run(spark, ["my model: v1/2"], T.run_suffix) == ["my_model_v1_2"]
    assert run(spark, ["# h\n\na\n b"], T.body_lines) == ["a\n b"]
    long = " ".join(str(i) for i in range(601))
    assert run(spark, [long], T.excerpt)[0].split() == [str(i) for i in range(150, 650) if i < 601]
    assert run(spark, ["abcdef", "ab"], lambda t: T.truncate(t, 3)) == ["abc...", "ab"]


def test_whole_standard_list(spark):
    """By default every literal of the standard file counts, one listed twice for each time."""
    assert len(Z.STANDARD.literals) == 246 and Z.STANDARD.regexes == Z.STANDARD_REGEXES
    once = {x.lower(): sum(y.lower() == x.lower() for y in Z.STANDARD.literals) for x in Z.STANDARD.literals}
    texts = ["As an AI I cannot. Elara was ethereal.", "nothing of the kind here", *once]
    got = run(spark, texts, Z.lazy)
    want = [sum(t.lower().count(x) * n for x, n in once.items()) for t in texts]
    names = {x.lower() for x in once}
    have = [sum(h["n"] for h in r["lazy_patterns_found"] if h["pattern"].lower() in names) for r in got]
    assert have == want and have[0] >= 4 and have[1] == 0 and min(have[2:]) >= 1


def test_standard_patterns_against_plain_python(spark):
    """Every standard literal and regex, back-references included, against Python's own counts."""
    import re

    from proseline.functions.lazy import STANDARD, lazy
    from tests.conftest import DATA

    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    odd = ["As an AI, I cannot. The sky. The sea. The end!!!! no no no", "", None, "eyes of steel... so it goes ...", "He muttered softly; slowly reached. tasted like iron and salt", "Not today, not ever"]
    rows = rows.unionByName(spark.createDataFrame([(-i - 1, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    for r in rows.withColumn("m", lazy(F.col("text"))).collect():
        text = r["text"] or ""
        want = [(s, text.lower().count(s.lower())) for s in STANDARD.literals] + [(p, len(list(re.finditer(p, text, re.I)))) for p in STANDARD.regexes]
        assert [tuple(h) for h in r["m"]["lazy_patterns_found"]] == [(p, n) for p, n in want if n], r["doc_id"]


def test_unusable_patterns(spark, tmp_path, monkeypatch):
    """What can't be read means the fallback, and a regex that doesn't compile is passed over."""
    import builtins

    from proseline.functions.lazy import PatternSet, lazy, load_patterns

    def loaded(text):
        (tmp_path / "p.yaml").write_text(text)
        return load_patterns(str(tmp_path / "p.yaml"))

    for text in ("literal_strings: 5", "- a\n- b", "", "literal_strings: [1, 2]", "{", "regex_patterns: {a: b}"):
        assert loaded(text) == PatternSet()
    assert load_patterns(str(tmp_path / "none.yaml")) == PatternSet()
    real = builtins.__import__
    monkeypatch.setattr(builtins, "__import__", lambda name, *a, **k: (_ for _ in ()).throw(ImportError(name)) if name == "yaml" else real(name, *a, **k))
    assert loaded("literal_strings: [a]") == PatternSet()
    monkeypatch.undo()
    found = spark.createDataFrame([("a b a",)], "t string").select(lazy(F.col("t"), PatternSet(("b",), ("(", "a", "(?P<x>a)"))).alias("m")).first()["m"]
    assert [tuple(h) for h in found["lazy_patterns_found"]] == [("b", 1), ("a", 2)]
