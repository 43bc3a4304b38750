import random

import pytest

from proseline.llm import sql
from proseline.llm.urlfilter import RULES, brute_force, judge, op13_url_filter

from ..conftest import compare
from .helpers import folder

KIND = "action string, host string, path string"


def test_against_sql(spark):
    compare(spark, "op13", op13_url_filter, sql.OP13)


@pytest.fixture(scope="module")
def urls():
    odd = [None, "", "net/", "://", "http://", "http:///en/", "HTTP://A.Example.NET/en/x", "http://net", "http://net/", "x://org/fr/?q#f", "x://org/fr", "x://org?/fr/", "x://org#/fr/", "a://b://net/", "x://example.net:80/en/",
           "x://notexample.com/de/", "x://example.com/de/", "x://a.b.c.example.com/de/x/de/", "x://ÉXAMPLE.org/fr/", "x://.org/fr/", "x://org./fr/", "x://example.net/EN/", "x://a.net\n/en/", "x://" + "a." * 3000 + "net/" + "p/" * 5000]
    rng = random.Random(5)
    made = [f"http://{'.'.join(rng.choices(['a', 'b', 'example', 'org', 'net', 'com'], k=rng.randint(1, 4)))}{rng.choice(['', '/', '/en/', '/de/x', '/fr/', '/fr', '?a'])}" for _ in range(400)]
    return odd + made


def rows(spark, urls, rules, **options):
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)], "page_id long, url string, rule string").repartition(3)
    got = judge(pages, spark.createDataFrame(rules, KIND), **options)
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    return [tuple(r)[2:] for r in got.orderBy("page_id").collect()]


def test_given_rules(spark, urls):
    assert rows(spark, urls, RULES) == brute_force(urls)


def test_many_rules_in_several_cascades(spark, urls):
    rng = random.Random(7)
    rules = [(rng.choice(["allow", "block"]), ".".join(rng.choices(["a", "b", "example", "org", "net", "com", "A"], k=rng.randint(1, 3))), rng.choice([None, "", "/", "/en/", "/de", "/fr/"])) for _ in range(150)]
    want = brute_force(urls, rules)
    assert len({w[2] for w in want}) > 50
    assert rows(spark, urls, rules) == want
    assert rows(spark, urls, rules, most_bits=900) == want  # several cascades


def test_cascade_is_exact_with_a_poor_first_level(spark, monkeypatch):
    """Half of all keys pass level 0, so that more levels are needed."""
    from proseline.llm import urlfilter

    monkeypatch.setattr(urlfilter, "bits_for", lambda n, u: (1, 1))
    monkeypatch.setattr(urlfilter, "LATER", (2, 1))
    urls = [f"http://h{k}.net/" for k in range(300)]
    rules = [("block", f"h{k}.net", "/") for k in range(0, 300, 7)]
    assert rows(spark, urls, rules) == brute_force(urls, rules)


def test_defined_results(spark, tmp_path):
    assert rows(spark, ["http://net/", None], []) == [("net", "/", None, "allow"), ("", "", None, "allow")]
    assert rows(spark, ["http://net/"] * 2, [("allow", "net", "/"), ("block", "NET", "/")]) == [("net", "/", "net/", "block")] * 2
    for wrong in (("block", "", "/"), ("block", None, "/"), ("deny", "net", "/"), (None, "net", "/")):
        with pytest.raises(ValueError):
            rows(spark, ["http://net/"], [wrong])
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert op13_url_filter(spark, folder(spark, tmp_path, pages=empty)).collect() == []


def test_native(spark):
    plan = op13_url_filter(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Join" not in plan and "Exchange" not in plan
