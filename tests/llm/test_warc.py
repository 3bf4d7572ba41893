import glob
import gzip
import hashlib
import io
import random
import zlib

import pytest
from pyspark.sql import functions as F

from pelagia.llm import queries, warc
from pelagia.llm.common import new_path
from tests.conftest import as_rows, duck

SCHEMA = "page_id LONG, url STRING, html STRING"
BIG = "<p>" + "long page é " * 9000 + "</p>"
ROWS = [
    (1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (3, "http://a/3", BIG), (4, "http://a/4", BIG), (5, None, BIG), (5, None, BIG),
    (6, "http://a/x\r\nInjected: 1", "q" * 999), (7, "http://a/7", "q" * 999), (8, "u", "r" * 1000), (9, "u", "r" * 1000),
    (10, "u", None), (11, "u", ""), (None, "u", "s" * 2000), (None, None, None), (None, "u", "r" * 1000), (12, "u", "WARC/1.1\r\n\r\nx\r\n\r\nWARC/1.1\r\n" * 90),
]


def test_chunked():
    random.seed(1)
    for n in (0, 1, 7, 8, 9, 1000):
        data = random.randbytes(n)
        assert warc.unchunked(warc.chunked(data, 8)) == data
    assert warc.unchunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    for bad in (b"", b"5\r\nabc\r\n0\r\n\r\n", b"3\r\nabcd\r\n0\r\n\r\n", b"zz\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(bad)


@pytest.mark.parametrize("segment, broadcast, rows", [(700, 0, 1), (1 << 20, 1 << 20, 1024)])
def test_round_trip(spark, segment, broadcast, rows, monkeypatch):
    monkeypatch.setattr(warc, "ROW_BYTES", 300)
    path = new_path(spark, "warc-test")
    pages = spark.createDataFrame(ROWS, SCHEMA).withColumns({n: F.lit("x") for n in ("value", "_digest", "type")}).repartition(3)
    warc.write_archives(pages, path, segment_bytes=segment, broadcast_bytes=broadcast, archive_rows=rows)
    archives = glob.glob(path.removeprefix("file://") + "/*")
    assert len(archives) > 3 if rows == 1 else len(archives) <= 4
    got = warc.stored(spark, path).collect()
    assert len(got) == len(ROWS) and not any(r.error for r in got)
    biggest = {}
    for i, _, html in ROWS:
        if html and len(html.encode()) >= 1000 and i is not None:
            biggest[html] = max(i, biggest.get(html, i))
    want = []
    for i, _, html in ROWS:
        data = (html or "").encode()
        first = biggest.get(html)
        refers = first if first is not None and i != first else None
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "response" if refers is None else "revisit", refers, None if refers else data))
    number = lambda x: int(x.split(":")[2]) if x and x.split(":")[2] else None
    have = [(number(r.record_id), r.payload_bytes, r.payload_digest, r.type, number(r.refers_to), r.payload and bytes(r.payload) if r.type == "revisit" else bytes(r.payload)) for r in got]
    assert sorted(map(repr, have)) == sorted(map(repr, want))
    # each revisit leads to a record that holds its payload
    by_id = {r.record_id: r for r in got}
    revisits = [r for r in got if r.type == "revisit"]
    assert len(revisits) == sum(w[3] == "revisit" for w in want) > 2
    for r in revisits:
        held = by_id[r.refers_to]
        assert held.type == "response" and hashlib.sha1(bytes(held.payload)).hexdigest() == r.payload_digest and len(held.payload) == r.payload_bytes
    assert len(by_id) == len(set(ROWS))  # one record id for each different page


@pytest.mark.parametrize("broadcast, join", [(0, "SortMergeJoin"), (1 << 20, "BroadcastHashJoin")])
def test_references_shuffled_or_broadcast(spark, broadcast, join):
    pages = spark.createDataFrame([r for r in ROWS if r[0]], SCHEMA)
    marked = warc.with_revisits(pages, broadcast_bytes=broadcast)
    assert join in marked._jdf.queryExecution().executedPlan().toString()
    got = {(r.page_id, r._refers_to, r._refers_url) for r in marked.collect()}
    assert {(3, 5, None), (8, 9, "u"), (9, None, None), (5, None, None), (1, None, None)} <= got


def test_each_record_is_a_member(spark):
    path = new_path(spark, "warc-members")
    warc.write_archives(spark.createDataFrame([(k, f"u{k}", f"page {k}" * k) for k in range(300)], SCHEMA).repartition(2), path)
    seen = []
    for name in glob.glob(path.removeprefix("file://") + "/*.warc.gz"):
        data = open(name, "rb").read()
        while data:
            member = zlib.decompressobj(31)
            found = list(warc.parse(io.BytesIO(member.decompress(data))))
            assert len(found) == 1 and found[0][2] is None
            seen.append(found[0][0]["warc-target-uri"])
            data = member.unused_data
    assert sorted(seen) == sorted(f"u{k}" for k in range(300))


def test_foreign_archives_in_files(spark, tmp_path):
    text = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <i>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    tricky = b"x\r\n\r\nWARC/1.1\r\n\r\n" * 50
    text += b"WARC/1.0\nWARC-Type: resource\nWARC-Record-ID: <j>\nContent-Length: %d\n\n%b\n\n" % (len(tricky), tricky)
    (tmp_path / "one.warc.gz").write_bytes(gzip.compress(text))
    (tmp_path / "many.warc.gz").write_bytes(gzip.compress(text[:50]) + gzip.compress(text[50:]) + gzip.compress(text[: text.index(b"abc") + 2]))
    whole = [("i", b"abc", None), ("j", tricky, None)]
    got = [(r.record_id, bytes(r.block), r.error) for r in warc.read_archives(spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, [*whole, *whole, ("i", b"ab", "cut short")]))
    bare = tmp_path / "bare"
    bare.mkdir()
    (bare / "a.warc").write_bytes(text)
    assert sorted((r.record_id, bytes(r.block), r.error) for r in warc.read_archives(spark, str(bare), compressed=False).collect()) == whole


def records(spark, rows):
    ddl = warc.RECORDS
    return spark.createDataFrame(rows, ddl)


def part(origin, k, block, total=None, kind="continuation", error=None):
    return (f"{origin}:{k}" if k > 1 else origin, kind if k > 1 else "response", "u", None, None, origin if k > 1 else None, k, total, block, error)


def test_reassembly(spark):
    rows = [
        part("a", 3, b"ef", 6), part("a", 1, b"ab"), part("a", 2, b"cd"),
        part("gap", 1, b"ab"), part("gap", 3, b"ef", 6),
        part("short", 1, b"ab"), part("short", 2, b"cd", 9),
        part("open", 1, b"ab"), part("open", 2, b"cd"),
        part("lost", 2, b"cd", 4),
        part("two", 1, b"x"), part("two", 1, b"x"), part("two", 2, b"y", 2), part("two", 2, b"y", 2),
        part("odd", 1, b"x"), part("odd", 1, b"z"), part("odd", 2, b"y", 2), part("odd", 2, b"y", 2),
        ("w", "response", "u", None, None, None, None, None, b"whole", None),
    ]
    got = warc.reassemble(records(spark, rows)).collect()
    good = sorted((r.record_id, bytes(r.block)) for r in got if not r.error)
    assert good == [("a", b"abcdef"), ("two", b"xy"), ("two", b"xy"), ("w", b"whole")]
    bad = {r.record_id: r.error for r in got if r.error}
    assert bad.keys() == {"gap", "short", "open", "lost", "odd"} and "4 bytes of 9" in bad["short"]
    assert warc.reassemble(records(spark, [])).collect() == []


def test_foreign_archives():
    text = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\nwarc-type: response\r\nX-Folded: a\r\n b\r\nContent-Length: 10\r\n\r\nshort"
    for stream in (io.BytesIO(text), io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(gzip.compress(text[:70]) + gzip.compress(text[70:]))))):
        found = list(warc.parse(stream))
        assert [(f.get("warc-type"), b, e) for f, b, e in found] == [("warcinfo", b"abc", None), ("response", b"short", "cut short")]
        assert found[1][0]["x-folded"] == "a b"


def test_query_against_sql(spark, sf):
    got = queries.op10_warc(spark, sf).toPandas()
    assert as_rows(got) == as_rows(duck(sf).execute(queries.ORACLES["op10_warc"]).df())


def test_empty(spark):
    path = new_path(spark, "warc-empty")
    warc.write_archives(spark.createDataFrame([], SCHEMA), path)
    assert warc.stored(spark, path).collect() == []
