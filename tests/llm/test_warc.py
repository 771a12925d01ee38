import gzip
import hashlib

from pyspark.sql import functions as F

from ledgerlens.llm import warc
from ledgerlens.llm.queries import QUERIES
from ledgerlens.session import scratch_path


def expected(rows):
    last = {}
    for page, body in rows:
        if len(body) >= 1000 and page is not None:
            last[body] = max(last.get(body, page), page)
    out = []
    for page, body in rows:
        again = body in last and page is not None and page != last[body]
        out.append((page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", last[body] if again else None))
    return sorted(map(repr, out))


def test_whole_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    got = QUERIES["op9_warc_capture_index"](spark, sf_dir).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(repr(tuple(r)) for r in got.collect()) == expected(rows)


def test_duplicates_blocks_and_edges(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    big = "<p>" + "é" * 600 + "</p>"
    rows = [(i, f"http://www.h{i % 3}.example.com/x?{i % 2}", big if i % 4 else "small") for i in range(40)]
    rows += [(50, None, None), (51, "not a url ]", ""), (None, "http://a.b/", "x" * 2000), (52, "http://[bad", "y" * 1500), (53, "http://a.b/", "y" * 1500)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x")).withColumn("urlkey", F.lit("y")).repartition(5)
    got = warc.archive_round_trip(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(repr(tuple(r)) for r in got) == expected([(p, (h or "").encode()) for p, _, h in rows])
    assert warc.archive_round_trip(df.limit(0)).collect() == []


def test_files_are_warc_and_lookups_are_ranges(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    root = scratch_path(spark, "warc-test")
    captures = warc.write_archives(pages, root)
    warc.write_index(captures, root, f"{root}-directory")
    some = captures.orderBy("page_id").limit(5)
    found = {r.page_id: r for r in warc.read_archives(some, f"{root}-directory", payloads=True).collect()}
    html = {r.page_id: r.html for r in pages.collect()}
    assert len(found) == 5 and all(r.payload is None or bytes(r.payload).decode() == html[p] for p, r in found.items())
    one = captures.first()
    fs, path = warc.filesystem(one.file)
    with fs.open_input_file(path) as f:
        head = gzip.decompress(f.read_at(one.length, one.offset))
    assert head.startswith(b"WARC/1.1\r\n") and f"page:{one.page_id}>".encode() in head


def test_keys():
    assert warc.reversed_host_key("https://www.Blog.Example.com/A/b?Q=1") == "com,example,blog)/a/b?q=1"
    assert warc.reversed_host_key("http://a.b:8080") == "b,a:8080)/"
