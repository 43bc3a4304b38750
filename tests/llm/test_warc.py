import gzip
import re

import pyarrow as pa
import pytest

from proseline.llm.registry import ORACLE_SQL
from proseline.llm.warc import Window, first_border, mark_revisits, parse_header, op2_warc, read_warc, write_warc
from tests.conftest import compare
from tests.llm.helpers import folder

BIG = "<p>é " + "x" * 200 + "</p>"
PAGES = [(5, "http://a/", BIG), (3, "http://b/\r\nX: y%", BIG), (4, None, "short"), (1, "u", "short"), (2, "u", None), (9, "u", ""), (7, "u", BIG), (8, "u", "y" * 100), (6, "u", "y" * 100), (10, "u", "z" * 300_000)]


def test_sql(spark):
    compare(spark, "op2", op2_warc, ORACLE_SQL["op2_warc"])


def test_edges(spark, tmp_path):
    sf = folder(spark, tmp_path, pages=spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3))
    compare(spark, "op2", op2_warc, ORACLE_SQL["op2_warc"], sf)
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in op2_warc(spark, sf).collect()}
    assert got[3] == ("response", None) and got[5] == ("revisit", 3) == got[7] and got[8] == ("revisit", 6) and got[1][0] == got[4][0] == got[2][0] == "response"
    empty = folder(spark, tmp_path, pages=spark.createDataFrame([], "page_id long, url string, html string"))
    assert op2_warc(spark, empty).count() == 0


def test_round_trip_and_filters(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    rows = [("urn:1", "response", "http://x/\r\n%41", b"\x00\xff\r\n\r\nWARC/1.1"), ("urn:2", "metadata", None, None), ("urn:3", "response", "u", b"")]
    df = spark.createDataFrame(rows, "record_id string, record_type string, target_uri string, payload binary")
    write_warc(df.repartition(2), path)
    write_warc(df.limit(1), path)
    got = read_warc(spark, path)
    assert got.count() == 4
    back = {(r["record_id"], r["target_uri"], bytes(r["payload"])) for r in got.collect()}
    assert all(re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", r["warc_date"]) for r in got.collect())
    assert back == {("urn:1", "http://x/\r\n%41", b"\x00\xff\r\n\r\nWARC/1.1"), ("urn:2", None, b""), ("urn:3", "u", b"")}
    only = read_warc(spark, path, ["record_id", "record_type"]).where("record_type = 'metadata'")
    assert [r["record_id"] for r in only.collect()] == ["urn:2"]
    assert "Filter" not in only._jdf.queryExecution().executedPlan().toString().split("BatchScan")[0].replace("PushedFilters", "")


def test_splits_cover_all_records(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    write_warc(spark.range(500).selectExpr("concat('r', id) AS record_id", "'response' AS record_type", "cast(repeat(cast(id AS string), 300) AS binary) AS payload").coalesce(1), path)
    split = spark.read.format("warc").option("split_bytes", "5000").load(path)
    assert split.rdd.getNumPartitions() > 3
    assert sorted(r["record_id"] for r in split.collect()) == sorted(f"r{i}" for i in range(500))


def test_nulls_in_any_column(spark):
    df = spark.createDataFrame([(None, b"x" * 200), (None, b"x" * 200), (1, b"x" * 200), (2, None)], "page_id long, payload binary")
    rows = mark_revisits(df).collect()
    assert len(rows) == 4 and all(r["record_type"] == "response" for r in rows)


def record(n, kind="response", body=None, folded=False, eol="\r\n"):
    """A record as other writers have it: an HTTP message, other letter case, no space after the colon, a folded line."""
    body = body if body is not None else f"<html>page {n}</html>".encode() * (n % 50 + 1)
    block = b"HTTP/1.0 200 OK\r\nServer: x\r\n\r\n" + body if kind == "response" else body
    head = ["WARC/1.0", f"warc-type:{kind}", f"WARC-Record-ID: <urn:uuid:{n}>", "WARC-Date: 2020-01-01T00:00:00Z", f"WARC-Target-URI:  http://h/{n}"]
    head += [f"X-Long: a{eol} b"] if folded else []
    head += ["Content-Type: application/http;msgtype=response" if kind == "response" else "Content-Type: text/plain", f"CONTENT-LENGTH: {len(block)}"]
    return (eol.join(head) + eol + eol).encode("latin-1") + block + b"\r\n\r\n", body


def foreign(n=300):
    made = [record(k, ["response", "metadata", "request"][k % 3], folded=k % 2 == 0) for k in range(n)]
    made[10] = record(10, "metadata", b"\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc in a payload\r\n\r\nWARC/ \x1f\x8b\x08")
    made[11] = record(11, "response", b"big " * 50_000)
    info = record("info", "warcinfo", b"software: other\r\n")
    return [info, *made]


@pytest.mark.parametrize("form", ["plain", "members", "one_member"])
@pytest.mark.parametrize("split", ["1000000000", "3000"])
def test_foreign_files(spark, tmp_path, form, split):
    """Files of other writers, without index: every record is read once, however they are split."""
    made = foreign()
    data = {"plain": lambda: b"".join(r for r, _ in made), "members": lambda: b"".join(gzip.compress(r) for r, _ in made), "one_member": lambda: gzip.compress(b"".join(r for r, _ in made))}[form]()
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / ("a.warc" if form == "plain" else "a.warc.gz")).write_bytes(data)
    (tmp_path / "in" / "empty.warc").write_bytes(b"")
    (tmp_path / "in" / "notes.txt").write_bytes(b"no archive")
    path = f"file://{tmp_path}/in"
    read_warc(spark, path)
    df = spark.read.format("warc").option("split_bytes", split).load(path)
    rows = df.collect()
    assert sorted((r["record_id"], bytes(r["payload"])) for r in rows) == sorted((f"urn:uuid:{n}", body) for n, (_, body) in zip(["info", *range(300)], made, strict=True))
    assert {r["warc_date"] for r in rows} == {"2020-01-01T00:00:00Z"} and all(r["target_uri"].startswith("http://h/") for r in rows)
    only = df.where("record_type = 'metadata'").select("record_id")
    assert only.count() == sum(parse_header(r)["warc-type"] == "metadata" for r, _ in made)
    heads = read_warc(spark, path, ["record_id", "record_type"]).where("record_type IN ('request', 'warcinfo')")
    assert heads.count() == sum(parse_header(r)["warc-type"] in ("request", "warcinfo") for r, _ in made)


def test_broken_files(spark, tmp_path):
    """What is no record is passed over; a record cut short is left out."""
    whole = [record(k)[0] for k in range(5)]
    (tmp_path / "cut.warc").write_bytes(b"".join(whole)[:-40])
    (tmp_path / "lead.warc").write_bytes(b"junk\n" + b"".join(whole))
    (tmp_path / "cut.warc.gz").write_bytes(b"".join(map(gzip.compress, whole))[:-30])
    (tmp_path / "odd.warc").write_bytes(record(7, eol="\n")[0] + b"WARC/1.0\r\nno length\r\n\r\n")
    ids = lambda name: sorted(r["record_id"][9:] for r in read_warc(spark, f"file://{tmp_path}/{name}").collect())
    assert ids("cut.warc") == ids("cut.warc.gz") == list("0123") and ids("lead.warc") == list("01234") and ids("odd.warc") == ["7"]


def test_written_files_are_standard(spark, tmp_path):
    """A member for each record, a warcinfo record first, ids in brackets, dates, and lengths that hold."""
    path = f"{tmp_path}/w"
    write_warc(spark.range(20).selectExpr("concat('urn:', id) AS record_id", "'response' AS record_type", "'http://h/' AS target_uri", "cast(repeat('é', cast(id AS int)) AS binary) AS payload").coalesce(1), f"file://{path}")
    name = next(p for p in (tmp_path / "w").iterdir() if p.name.endswith(".warc.gz"))
    data = name.read_bytes()
    starts, at = [], 0
    while at is not None and at < len(data):
        at = first_border(Window(pa.BufferReader(data)), at, len(data), True)
        if at is not None:
            starts.append(at)
            at += 1
    records = [gzip.decompress(data[a:b]) for a, b in zip(starts, [*starts[1:], len(data)], strict=True)]
    assert len(records) == 21
    for k, r in enumerate(records):
        head, block = r.split(b"\r\n\r\n", 1)
        h = parse_header(head)
        assert h[""] == "WARC/1.1" and re.fullmatch("<.+>", h["warc-record-id"]) and "warc-date" in h and h["warc-type"] == ("response" if k else "warcinfo")
        assert len(block) == int(h["content-length"]) + 4 and block.endswith(b"\r\n\r\n")
        assert not k or block.startswith(b"HTTP/1.1 200 OK\r\n")


def test_hot_payload_and_clashes(spark):
    df = spark.range(3000).selectExpr("id AS page_id", "cast(repeat(IF(id % 3 = 0, 'hot', cast(id % 700 AS string)), 100) AS binary) AS payload", "'x' AS Record_Type", "1 AS revisit_id")
    rows = mark_revisits(df)
    assert rows.columns == ["page_id", "payload", "revisit_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    first = {}
    for r in sorted(rows.collect()):
        want = first.setdefault(bytes(r["payload"]), r["page_id"])
        assert (r["record_type"], r["refers_to"]) == (("response", None) if want == r["page_id"] else ("revisit", want))


def test_repeated_ids(spark):
    """An id with several payloads: each is judged by itself, and none is lost."""
    import random

    rng = random.Random(4)
    body = lambda c: c * 120
    cases = [[(1, "A"), (2, "A"), (2, "B"), (3, "B")], [(rng.randrange(12), rng.choice("ABCDEF")) for _ in range(80)], [(None, "A"), (None, "A"), (5, "A")], [(1, "A"), (1, "A")]]
    for rows in cases:
        df = spark.createDataFrame([(i, body(c).encode()) for i, c in rows], "page_id long, payload binary").repartition(3)
        got = sorted((r["page_id"], bytes(r["payload"])[:1].decode(), r["record_type"], r["refers_to"]) for r in mark_revisits(df).collect() if r["page_id"] is not None)
        first = {}
        for i, c in rows:
            if i is not None:
                first[c] = min(i, first.get(c, i))
        assert got == sorted((i, c, "response" if first[c] == i else "revisit", None if first[c] == i else first[c]) for i, c in rows if i is not None), rows
