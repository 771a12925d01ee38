"""Decoders, sinks, layout, the seeded dashboard, and the streams."""

import base64
import zipfile
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators.layout import fuse_page
from ledgerlens.plans.aggregates import accuracy, document_stats
from ledgerlens.plans.evaluation import ground
from ledgerlens.plans.projections import document_states
from ledgerlens.sources import sinks
from ledgerlens.sources.decoders import decode_tlv, qr_payload, tlv_text, ubl_fields
from ledgerlens.streaming.ingest import debounced, dedupe_ingest, stalled_documents


def tlv(*entries):
    return base64.b64encode(b"".join(bytes([t, len(v)]) + v for t, v in entries)).decode()


def test_tlv(spark):
    full = [(1, "شركة".encode()), (2, b"310122393500003"), (3, b"2026-02-10T11:35:00Z"), (4, b"52118.00"), (5, b"6798.00"), (6, b"\xff\x00"), (5, b"6799.00")]
    rows = [(0, tlv(*full)), (1, tlv(*full)[:-8]), (2, "*bad"), (3, ""), (4, None), (5, tlv(*full[:4])), (6, tlv(*full[:3], (4, b"x"), (5, b"1")))]
    df = spark.createDataFrame(rows, "i int, qr string")
    items = decode_tlv(F.col("qr"))
    got = {r.i: r for r in df.select("i", items.alias("t"), tlv_text(items, 1).alias("name"), tlv_text(items, 5).alias("vat"), qr_payload(F.col("qr")).alias("p")).collect()}
    assert got[0].name == "شركة" and got[0].vat == "6799.00" and got[0].t[5].value == "FF00" and got[0].p.issue_date == "2026-02-10"
    assert all(got[i].t is None for i in (1, 2, 3, 4)) and got[5].t is not None and got[5].p is None and got[6].p is None


def test_ubl(spark):
    body = '<Invoice xmlns:b="urn:b"><b:ID>SA-2026-0334</b:ID><b:IssueDate>2026-02-10</b:IssueDate><b:IssueTime>11:35:00Z</b:IssueTime><b:TaxTotal><b:TaxAmount currencyID="SAR">6,798.00</b:TaxAmount></b:TaxTotal></Invoice>'
    rows = [(0, body), (1, body[:-9]), (2, '<!DOCTYPE a [<!ENTITY x SYSTEM "file:///etc/passwd">]>' + body), (3, None), (4, "<Invoice></Invoice>")]
    got = {r.i: r for r in ubl_fields(spark.createDataFrame(rows, "i int, xml string")).collect()}
    assert got[0].invoice_number == "SA-2026-0334" and str(got[0].issue_date) == "2026-02-10" and got[0].issue_time == "11:35:00" and str(got[0].vat_amount) == "6798.0000"
    assert not any(got[i].well_formed for i in (1, 2, 3)) and got[4].invoice_number is None


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "=1+1", -5), (2, 'a "b", c', None), (3, None, 7)], "id int, text string, n int")
    sinks.write_csv(df, str(tmp_path / "x.csv"), ["id", "text", "n"], ["id"])
    assert (tmp_path / "x.csv").read_bytes().decode("utf-8") == "\ufeffid,text,n\r\n1,'=1+1,-5\r\n2,\"a \"\"b\"\", c\",\r\n3,,7\r\n"
    sinks.write_xlsx(str(tmp_path / "x.xlsx"), {"Invoice": df, "LineItems": df.limit(1)})
    with zipfile.ZipFile(tmp_path / "x.xlsx") as z:
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
    assert '<c t="inlineStr"><is><t xml:space="preserve">=1+1</t></is></c><c><v>-5</v></c>' in sheet
    sinks.write_markdown(df.orderBy("id").limit(1), str(tmp_path / "x.md"))
    assert (tmp_path / "x.md").read_text() == "| id | text | n |\n| --- | --- | --- |\n| 1 | =1+1 | -5 |\n"
    old = spark.createDataFrame([(1, None, "a"), (1, 0, "b")], "k int, r int, v string")
    new = spark.createDataFrame([(1, None, "c"), (2, None, "d")], "k int, r int, v string")
    assert sorted(map(tuple, sinks.upsert(old, new, ["k", "r"]).collect()), key=str) == [(1, 0, "b"), (1, None, "c"), (2, None, "d")]


def test_rows_fuse_only_around_the_script():
    fragment = lambda n, x0, x1, y0, rtl: (1, n, rtl, x0, y0, x1, y0 + 10.0)
    page = pd.DataFrame(
        [fragment(0, 50.0, 60.0, 0.0, True), fragment(1, 40.0, 48.0, 1.0, False), fragment(2, 10.0, 20.0, 1.0, True), fragment(3, 22.0, 30.0, 30.0, False), fragment(4, 31.0, 40.0, 30.0, False)],
        columns=["doc_id", "ord", "rtl", "x0", "y0", "x1", "y1"],
    )
    assert fuse_page(page)["row"].tolist() == [0, 0, 1, 2, 3]


def test_grounding(spark):
    words = spark.createDataFrame([(1, i, w, i * 10, i * 10 + 9) for i, w in enumerate("Invoice Jubail Maintenance Services total ٥٢١١٨".split())], "doc_id long, pos int, word string, x0 int, x1 int")
    values = spark.createDataFrame([(1, v) for v in ("Jubail Maintenance Services", "52118", "absent thing", "", "Jubail Maintenence Services")], "doc_id long, value string")
    got = {r.value: r for r in ground(values, words).collect()}
    assert (got["Jubail Maintenance Services"].score, got["Jubail Maintenance Services"].x0, got["Jubail Maintenance Services"].x1) == (100.0, 10.0, 39.0)
    assert got["52118"].pos == 5 and got["absent thing"].pos is None and got[""].pos is None and 85 <= got["Jubail Maintenence Services"].score < 100


NOW = datetime(1998, 1, 1, 1, 0, 0)


def test_dashboard_golden(spark):
    """The seeded tenant with hand-computed answers."""
    docs = [("processing", 5, False), ("clean", 60, True), ("blocked", 120, False), ("failed", 180, False), ("stalled", 86400, False), ("one", 240, True), ("two", 300, False)]
    documents = spark.createDataFrame([(n, NOW - timedelta(seconds=s), u) for n, s, u in docs], "id string, created_at timestamp, has_embedded_ubl boolean")
    status = [("clean", "to_review", None), ("blocked", "to_review", "m"), ("failed", "failed", None), ("one", "confirmed", None), ("two", "approved", "m")]
    annotations = spark.createDataFrame([(i, d, NOW, s, m) for i, (d, s, m) in enumerate(status)], "id long, document_id string, created_at timestamp, status string, model_version string")
    findings = spark.createDataFrame([(1, "GRAND_TOTAL_MISMATCH", "error", False, "x"), (2, "PIPELINE_FAILED", "error", False, "y")], "annotation_id long, rule_code string, severity string, passed boolean, message_en string")
    got = document_stats(documents, annotations, findings).first().asDict()
    assert got == {"documents_total": 7, "processed": 4, "in_progress": 1, "awaiting_review": 2, "blocked": 1, "confirmed": 2, "failed": 2, "from_signed_xml": 2}
    assert {r.id: r.st for r in document_states(documents, annotations).collect()}["stalled"] == "stalled"
    cells = [(3, "a", "x", None), (3, "b", "10.00", "12.00"), (3, "c", "y", None), (3, "d", None, None), (3, "e", None, "z"), (3, "f", "w", "w"), (4, "g", "v1", None), (4, "h", "v2", None)]
    fields = spark.createDataFrame([(a, k, None, e, f) for a, k, e, f in cells], "annotation_id long, field_key string, row_index int, value_extracted string, value_final string")
    log = spark.createDataFrame([(1, 3, "c", None, "delete")], "id long, annotation_id long, field_key string, row_index int, action string")
    assert tuple(accuracy(fields, log, annotations).first()) == (2, 7, 3)
    assert accuracy(fields, log, annotations.where("id < 3")).collect() == []


def drain(stream, name, spark, mode="append"):
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    return query


def test_streams(spark, tmp_path):
    """Files arrive one by one: repeats go, and a document without an annotation stalls once time has passed."""
    src = tmp_path / "src"
    schema = "document_id long, ts timestamp, kind string, org_id string, content string"
    src.mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    at = lambda s: NOW + timedelta(seconds=s)
    batches = [[(1, at(0), "upload", "o", "A"), (2, at(1), "upload", "o", "A")], [(1, at(60), "annotation", "o", "B")], [(3, at(5000), "upload", "o", "C")], [(4, at(9000), "upload", "p", "A")]]
    marked = stream.withWatermark("ts", "10 seconds")
    stalled = drain(stalled_documents(marked.select("document_id", "ts", "kind")), "stalled_docs", spark)
    unique = drain(dedupe_ingest(marked).select("org_id", "content"), "unique_docs", spark)
    try:
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
            stalled.processAllAvailable()
            unique.processAllAvailable()
        assert [r.document_id for r in spark.table("stalled_docs").collect()] == [2, 3]
        assert sorted(map(tuple, spark.table("unique_docs").collect())) == [("o", "A"), ("o", "B"), ("o", "C"), ("p", "A")]
    finally:
        stalled.stop()
        unique.stop()


def test_debounce(spark):
    ms = lambda x: NOW + timedelta(milliseconds=x)
    events = spark.createDataFrame([(1, 1, ms(0)), (1, 2, ms(700)), (1, 3, ms(1501)), (2, 4, ms(100))], "user_id long, event_id long, ts timestamp")
    assert sorted((r.user_id, r.edits, r.last_event) for r in debounced(events).collect()) == [(1, 1, 3), (1, 2, 2), (2, 1, 4)]


def test_storage_and_zip_ranges(spark, tmp_path):
    from ledgerlens.sources.storage import Storage, zip_entries

    store = Storage(str(tmp_path))
    store.put("org/1/a.bin", b"abc")
    assert store.get("org/1/a.bin") == b"abc" and store.exists("org/1") and not store.exists("org/2")
    store.delete_prefix("org/1")
    assert not store.exists("org/1/a.bin")
    for key in ("../x", "/etc/passwd", "a/../b", ""):
        with pytest.raises(ValueError, match="unsafe"):
            store.put(key, b"")
    with zipfile.ZipFile(tmp_path / "z.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(5):
            z.writestr(f"qa/{i}.json", f"{{{i}}}")
        z.writestr("other.txt", "no")
    got = zip_entries(spark, f"file://{tmp_path}/z.zip", r"qa/.*\.json").collect()
    assert sorted((r.name, bytes(r.content).decode()) for r in got) == [(f"qa/{i}.json", f"{{{i}}}") for i in range(5)]


def test_tenant_scope_with_negative_control(spark):
    from ledgerlens.operators.tenancy import TenantScope

    tables = {"docs": spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, org_id string"), "codes": spark.range(2), "secret": spark.range(2)}
    scope = TenantScope(tables.__getitem__, "a", shared=frozenset({"codes"}))
    assert [r.id for r in scope.table("docs").collect()] == [1] and scope.table("codes").count() == 2
    assert scope.unscoped("docs").count() == 3  # the bypass must see more, or the scope proves nothing
    with pytest.raises(PermissionError):
        scope.table("secret")
    with pytest.raises(ValueError, match="tenant"):
        TenantScope(tables.__getitem__, None)
