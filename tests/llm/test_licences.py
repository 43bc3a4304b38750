import re
import textwrap

import pytest

from proseline.llm.licences import FOLDER, bigrams, hashed, op6_licences, scan_licences, standard_templates
from proseline.llm.registry import ORACLE_SQL
from tests.conftest import compare
from tests.llm.helpers import docs, folder

WHOLE = {p.stem: p.read_text() for p in sorted(FOLDER.glob("*.txt"))}
NOTICES = [line.split("\t") for line in (FOLDER / "NOTICES").read_text().splitlines()]
MIT = WHOLE["MIT"]
CODE = "import os\n\n\ndef walk(path):\n    for x in os.listdir(path):\n        yield x  # the name of the file, in no order\n" * 5
TEXTS = [
    None, "", "\n\n", "word", "plain text of no licence", "Licensed under the Apache License, Version 2.0.", "LICENSED under the apache  license -- version 2.0!\nmore text here",
    "This work is licensed under the GNU General Public License, version 3.", "This work is licensed under the GNU General Public License, version 2.", MIT, "intro line\n\n" + MIT.replace(", ", ",\n") + "\n\nend",
    "Released under the MIT License.\n" * 500 + "x " * 20_000, "Released under MIT", "é Released under the MIT License", "Permission is hereby granted", "in one line, released under the MIT licence or license " * 3,
    "MIT License\n\nCopyright (c) 2020 Somebody\n\n" + MIT + "\n\n" + WHOLE["BSD-2-Clause"], MIT.replace("Software", "Program"), " ".join(MIT.split()[:60]),
]


def found(spark, texts, **options):
    rows = scan_licences(docs(spark, texts), **options).collect()
    return {r["doc_id"]: [h["licence"] for h in r["licence_hits"]] for r in rows}


def test_sql(spark, tmp_path):
    compare(spark, "op6", op6_licences, ORACLE_SQL["op6_licences"])
    texts = [*TEXTS, *WHOLE.values(), *(CODE + n for _, n in NOTICES)]
    compare(spark, "op6", op6_licences, ORACLE_SQL["op6_licences"], folder(spark, tmp_path, documents=docs(spark, texts)))


def test_edges(spark):
    got = found(spark, TEXTS)
    assert [got[i] for i in range(5)] == [[]] * 5
    assert got[5] == got[6] == ["Apache-2.0"] and got[7] == ["GPL-3.0"] and got[8] == ["GPL-2.0"] and got[9] == got[10] == got[11] == got[13] == ["MIT"] and got[14] == []
    assert got[16] == ["BSD-2-Clause", "MIT"] and got[17] == ["MIT"] and got[18] == []
    assert scan_licences(docs(spark, TEXTS).limit(0)).count() == 0
    plan = scan_licences(docs(spark, TEXTS))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Join", plan)
    assert bigrams("A b, a B.") == [("a", "b"), ("b", "a"), ("a", "b")]
    row = spark.sql("SELECT xxhash64('the', 'licence') AS h").first()
    assert row["h"] == hashed(("the", "licence"))
    clash = scan_licences(docs(spark, [MIT]).withColumnRenamed("lang", "Licence_Hits"))
    assert clash.first()["licence_hits"][0]["licence"] == "MIT" and len(clash.columns) == 5
    assert found(spark, [MIT], templates=[]) == {0: []}
    hit = scan_licences(docs(spark, ["one two three " + MIT + " four"])).first()["licence_hits"][0]
    assert (hit["start"], hit["dice"]) == (3, 1.0) and hit["stop"] == 3 + len(bigrams(MIT))


@pytest.mark.parametrize("way", ["whole", "wrapped", "inside"])
def test_every_licence_is_itself_and_nothing_else(spark, way):
    """Whole texts and standard notices, as they are, wrapped as comments, and inside a file after a copyright line."""
    cases = [*WHOLE.items(), *((n, t) for n, t in NOTICES)]
    change = {
        "whole": lambda t: t,
        "wrapped": lambda t: "\n".join("# " + x for x in textwrap.wrap(t, 72)),
        "inside": lambda t: CODE + "Copyright (c) 2021 The Authors\n\n" + t + "\n\n" + CODE,
    }[way]
    got = found(spark, [change(t) for _, t in cases])
    wrong = [(n, t[:60], got[i]) for i, (n, t) in enumerate(cases) if got[i] != [n]]
    assert not wrong, wrong


def test_every_pair_of_texts(spark):
    """Two whole texts, one after the other: both are found, each by its whole window. One exception: the end of GFDL-1.3 (what is new
    in it) and a GFDL-1.2 after it are together taken for a second GFDL-1.3."""
    names = sorted(WHOLE)
    pairs = [(a, b) for a in names for b in names if a != b]
    rows = scan_licences(docs(spark, [WHOLE[a] + "\n\n" + WHOLE[b] for a, b in pairs])).collect()
    n = {k: len(bigrams(t)) for k, t in WHOLE.items()}
    wrong = []
    for r in rows:
        a, b = pairs[r["doc_id"]]
        hits = {h["licence"]: (h["start"], h["stop"], h["dice"]) for h in r["licence_hits"]}
        want = {a: (0, n[a], 1.0), b: (n[a] + 1, n[a] + 1 + n[b], 1.0)}
        if hits != want and (a, b) != ("GFDL-1.3", "GFDL-1.2"):
            wrong.append((a, b, hits))
    assert not wrong, wrong[:5]


def test_edited_texts(spark):
    """A licence with 4 % of its words changed is still found; with half of them changed it is not."""
    names = [n for n, t in WHOLE.items() if len(t.split()) > 60]
    edit = lambda t, k: " ".join("changed" if i % k == 0 else w for i, w in enumerate(t.split()))
    got = found(spark, [edit(WHOLE[n], 25) for n in names] + [edit(WHOLE[n], 2) for n in names])
    for i, n in enumerate(names):
        assert got[i] == [n], (n, got[i])
        assert got[i + len(names)] == []


def test_thresholds_and_templates_are_parameters(spark):
    own = [("own", "one two three four five six"), ("other", "seven eight")]
    texts = ["one two three four five six", "zero one two three four nine", "seven eight", "eight seven"]
    assert found(spark, texts, templates=own) == {0: ["own"], 1: [], 2: ["other"], 3: []}
    assert found(spark, texts, templates=own, threshold=0.5) == {0: ["own"], 1: ["own"], 2: ["other"], 3: []}
    assert len(standard_templates()) == len(WHOLE) + len(NOTICES)
