import gzip
import hashlib

from pyspark.sql import functions as F

from tickloom.llm.warc import parse_record, read_records, write_archives

BIG = "<p>é" * 400
PAGES = [(1, "http://a/1", BIG), (2, "http://a/2", BIG), (9, "http://a/\r\n9", BIG), (3, None, None), (4, "u", ""), (5, "u", "x" * 999), (6, "u", "x" * 999), (7, "u", "WARC/1.1\r\n\r\nWARC-Type: revisit\r\n\r\n" * 50), (None, "u", BIG), (8, "u", "y" * 3_000_000), (9, "again", BIG)]


def test_round_trip(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS file").repartition(3)
    index = write_archives(df)
    rows = index.collect()
    assert len(rows) == len(PAGES)
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_digest, r.payload_bytes) for r in read_records(index).collect()), key=str)
    want = []
    for i, _, html in PAGES:
        raw = (html or "").encode()
        stored = len(raw) < 1000 or html != BIG or i == 9
        want.append((i, "response" if stored else "revisit", None if stored else 9, hashlib.sha1(raw).hexdigest(), len(raw)))
    assert got == sorted(want, key=str)
    # The archives are valid by themselves: members one after another, as the index says.
    for file in {r.file for r in rows}:
        raw = open(file.removeprefix("file:"), "rb").read()
        own = sorted((r.offset, r.length, r.url) for r in rows if r.file == file)
        assert own[0][0] == 0 and sum(n for _, n, _ in own) == len(raw)
        for offset, length, url in own:
            x = parse_record(gzip.decompress(raw[offset : offset + length]))
            assert x.get("warc-target-uri") == (url.replace("\r", "%0D").replace("\n", "%0A") if url else None)


def test_reading_is_dealt_out_by_bytes(spark):
    df = spark.range(200).selectExpr("id AS page_id", "'u' AS url", "concat(id, repeat('x', 1200), id % 3) AS html")
    index = write_archives(df)
    total = index.agg(F.sum("length")).first()[0]
    records = read_records(index, task_bytes=total // 5)
    assert records.rdd.getNumPartitions() >= 5 and records.count() == 200


def test_hot_payload(spark):
    pages = [(i, "u", BIG if i % 3 == 0 else f"{i % 500} " * 700) for i in range(900)] + [(None, "u", "z" * 2000)] * 2
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(7)
    rows = read_records(write_archives(df)).collect()
    keep = {}
    for i, _, html in pages:
        if i is not None:
            keep[html] = max(i, keep.get(html, -1))
    assert len(rows) == len(pages)
    for r in rows:
        html = next(h for i, _, h in pages if i == r.page_id)
        want = (None, "response") if keep.get(html, r.page_id) == r.page_id else (keep[html], "revisit")
        assert (r.refers_to, r.record_type) == want and r.payload_bytes == len(html.encode())


def test_selected_ranges_only(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1)
    index = write_archives(df)
    some = index.where(F.col("page_id").isin(4, 8))
    for gap in (0, 1 << 30):
        back = {r.page_id: bytes(r.payload) for r in read_records(some, gap=gap, keep_payload=True).collect()}
        assert back == {4: b"", 8: b"y" * 3_000_000}


def test_empty(spark):
    assert read_records(write_archives(spark.createDataFrame([], "page_id long, url string, html string"))).collect() == []
