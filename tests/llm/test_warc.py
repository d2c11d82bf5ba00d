import base64
import hashlib

from pyspark.sql import functions as F

from stratafold.llm import warc
from stratafold.scratch import materialize

PAGES = "page_id long, url string, html string, sha string, n long"


def pages(spark):
    big = "é" * 700_000
    rows = [(1, "http://a", None), (2, None, ""), (3, "u\r\nv", "same"), (4, "u", "same"), (5, "u", big), (6, "u", big), (7, "u", "x\r\n\r\nWARC/1.1\r\n"), (8, "u", "same")]
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], PAGES)


def want(rows, least=0):
    first = {}
    for r in sorted((r for r in rows if r["page_id"] is not None), key=lambda r: r["page_id"]):
        first.setdefault(r["html"] or "", r["page_id"])
    out = []
    for r in rows:
        raw = (r["html"] or "").encode()
        of = first.get(r["html"] or "") if len(raw) >= least and r["page_id"] is not None else r["page_id"]
        of = of if of != r["page_id"] else None
        out.append((r["page_id"], len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if of is None else "revisit", of))
    return sorted(out, key=str)


def found(pages, least=0):
    return sorted((tuple(r) for r in warc.archive_and_read(pages, least).collect()), key=str)


def test_round_trip(spark):
    for least in (0, 5):
        assert found(pages(spark), least) == want(pages(spark).collect(), least)
    assert found(pages(spark).limit(0)) == []
    twice = pages(spark).union(pages(spark))
    assert found(twice) == want(twice.collect())


def test_repeated_pages_with_other_payloads_and_null_pages(spark):
    rows = [(1, "AAA"), (1, "BBB"), (2, "AAA"), (3, "BBB"), (3, "AAA"), (3, "CCC"), (None, "AAA"), (None, "DDD"), (None, "DDD"), (4, "DDD"), (5, "DDD")]
    table = spark.createDataFrame([(p, "u", h, "x", 0) for p, h in rows], PAGES)
    assert found(table) == want(table.collect())


def test_a_payload_that_a_third_of_the_pages_share(spark):
    table = spark.createDataFrame([(i, None, "hot" if i % 3 == 0 else f"page {i}", "x", 0) for i in range(4000)], PAGES)
    assert found(table.repartition(5)) == want(table.collect())


def test_archive_bytes_are_a_warc_file(spark):
    rows = warc.archive(pages(spark), chunk=1000).collect()
    files = {}
    for r in sorted(rows, key=lambda r: (r["archive"], r["seq"])):
        files[r["archive"]] = files.get(r["archive"], b"") + bytes(r["bytes"])
    seen = 0
    for data in files.values():
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            n = int(warc.parse_header(head + b"\r\n\r\n")["Content-Length"])
            assert rest[n : n + 4] == b"\r\n\r\n"
            data, seen = rest[n + 4 :], seen + 1
    assert seen == 8


def test_records_torn_between_read_tasks(spark):
    torn = materialize(warc.archive(pages(spark), chunk=1000).repartition(7, F.col("seq")), "warc")
    got = {(r["page_id"], r["payload_bytes"]) for r in warc.read_records(torn).filter("kind = 'response'").collect()}
    assert got == {(p, n) for p, n, _, kind, _ in want(pages(spark).collect()) if kind == "response"}
