"""Queries of the decoders and sinks: documents are built from the bridge and decoded again."""

from __future__ import annotations

import io
import json
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F

from ledgerlens.operators.inference import infer
from ledgerlens.operators.layout import fuse_rows
from ledgerlens.plans.catalog import op
from ledgerlens.plans.projections import effective
from ledgerlens.plans.relations import LONG_SQL, export_rows
from ledgerlens.functions.tokens import sign, verify
from ledgerlens.sources.decoders import decode_tlv, parse_jsonl, pdf_attachments, qr_payload, read_ground_truth, tlv_text, ubl_fields
from ledgerlens.session import arrow_pass, materialize, scratch_path
from ledgerlens.sources.sinks import csv_lines, json_text, upsert, workbook_cells, workbooks
from ledgerlens.sources.storage import Storage, stored, zip_entries


def _xml(inv_header):
    """UBL texts with an unusual prefix; every 13th is cut off, every 17th has a DOCTYPE."""
    tag = lambda name, c: F.concat(F.lit(f"<c:{name}>"), F.coalesce(c.cast("string"), F.lit("")), F.lit(f"</c:{name}>"))
    k = F.col("annotation_id")
    refs = F.concat(F.when(F.col("has_icv"), "<c:AdditionalDocumentReference><c:ID>ICV</c:ID><c:UUID>7</c:UUID></c:AdditionalDocumentReference>").otherwise(""), F.when(F.col("has_pih"), "<c:AdditionalDocumentReference><c:ID>PIH</c:ID></c:AdditionalDocumentReference>").otherwise(""))
    body = F.concat(
        F.when(k % 17 == 0, '<!DOCTYPE x [<!ENTITY e "v">]>').otherwise(""), F.lit('<u:Invoice xmlns:u="urn:i" xmlns:c="urn:c">'), tag("ID", F.concat(F.lit("INV-"), k.cast("string"))),
        tag("IssueDate", F.date_format("created_at", "yyyy-MM-dd")), F.lit('<c:InvoiceTypeCode name="'), F.col("type_name"), F.lit('">'), F.col("type_code"), F.lit("</c:InvoiceTypeCode>"), refs,
        F.lit("<c:AccountingSupplierParty><c:Party><c:PartyTaxScheme>"), tag("CompanyID", F.col("seller_trn")), F.lit("</c:PartyTaxScheme></c:Party></c:AccountingSupplierParty>"),
        F.lit("<c:TaxTotal>"), tag("TaxAmount", F.col("vat")), F.lit("<c:TaxSubtotal><c:TaxCategory><c:ID>S</c:ID><c:Percent>15.00</c:Percent></c:TaxCategory></c:TaxSubtotal></c:TaxTotal>"),
        F.lit("<c:LegalMonetaryTotal>"), tag("TaxInclusiveAmount", F.col("total")), F.lit("</c:LegalMonetaryTotal>"),
        F.lit('<c:InvoiceLine><c:ID>1</c:ID><c:InvoicedQuantity unitCode="PCE">2</c:InvoicedQuantity><c:Price><c:PriceAmount>1.50</c:PriceAmount></c:Price></c:InvoiceLine>'),
        F.lit("<c:InvoiceLine><c:ID>2</c:ID><c:LineExtensionAmount>9.00</c:LineExtensionAmount></c:InvoiceLine>"), F.when(k % 13 == 0, "").otherwise("</u:Invoice>"),
    )
    return inv_header.select("annotation_id", body.alias("xml"))


@op("src_xml", "inv_header", oracle="""SELECT annotation_id, ok AS well_formed, CASE WHEN ok THEN 'INV-' || CAST(annotation_id AS VARCHAR) END AS invoice_number, CASE WHEN ok THEN CAST(created_at AS DATE) END AS issue_date,
  CASE WHEN ok THEN type_code END AS type_code, CASE WHEN ok THEN type_name END AS type_name, CASE WHEN ok THEN seller_trn END AS seller_trn, CASE WHEN ok THEN CAST(vat AS DOUBLE) END AS vat_amount,
  CASE WHEN ok THEN CAST(total AS DOUBLE) END AS total_amount, CASE WHEN ok THEN 15.0::DOUBLE END AS vat_percent, ok AND has_icv AS has_icv, ok AND has_pih AS has_pih, CASE WHEN ok THEN 2::BIGINT END AS n_lines
  FROM (SELECT *, annotation_id % 13 <> 0 AND annotation_id % 17 <> 0 AS ok FROM {inv_header}) h""")
def src_xml(inv_header):
    u = ubl_fields(_xml(inv_header))
    empty = lambda c: F.nullif(F.col(c), F.lit(""))
    return u.select(
        "annotation_id", "well_formed", "invoice_number", "issue_date", "type_code", "type_name", empty("seller_trn").alias("seller_trn"), F.col("vat_amount").cast("double").alias("vat_amount"),
        F.col("total_amount").cast("double").alias("total_amount"), F.col("vat_percent").cast("double").alias("vat_percent"), "has_icv", "has_pih", F.when(F.col("well_formed"), F.size("lines")).cast("long").alias("n_lines"),
    )


def _tlv(*texts):
    """base64 of tags 1.. with the given texts."""
    parts = [F.concat(F.lpad(F.hex(F.lit(i)), 2, "0"), F.lpad(F.hex(F.octet_length(t).cast("long")), 2, "0"), F.hex(F.encode(t, "UTF-8"))) for i, t in enumerate(texts, 1)]
    return F.regexp_replace(F.base64(F.unhex(F.concat(*parts))), r"\s", "")


def _qr(inv_header):
    """QR payloads; every fifth is cut, every seventh isn't base64, every ninth lacks its amount."""
    k = F.col("annotation_id")
    name = F.concat(F.lit("شركة "), F.col("o_custkey").cast("string"))
    total = F.when(k % 9 == 0, "").otherwise(F.coalesce(F.col("total").cast("string"), F.lit("1.00")))
    whole = _tlv(name, F.lit("310122393500003"), F.concat(F.date_format("created_at", "yyyy-MM-dd"), F.lit("T10:00:00Z")), total, F.coalesce(F.col("vat").cast("string"), F.lit("0.15")))
    cut = F.substring(whole, 1, 36)
    return inv_header.select("annotation_id", F.when(k % 5 == 0, cut).when(k % 7 == 0, F.concat(F.lit("*"), whole)).otherwise(whole).alias("qr"))


@op("sc_tlv", "inv_header", oracle="""SELECT annotation_id, ok, CASE WHEN ok THEN 'شركة ' || CAST(o_custkey AS VARCHAR) END AS seller, CASE WHEN ok THEN '310122393500003' END AS trn, CASE WHEN ok THEN 5::BIGINT END AS tags
  FROM (SELECT *, annotation_id % 5 <> 0 AND annotation_id % 7 <> 0 AS ok FROM {inv_header}) h""")
def sc_tlv(inv_header):
    items = F.col("items")
    return _qr(inv_header).withColumn("items", decode_tlv(F.col("qr"))).select("annotation_id", items.isNotNull().alias("ok"), tlv_text(items, 1).alias("seller"), tlv_text(items, 2).alias("trn"), F.when(items.isNotNull(), F.size(items)).cast("long").alias("tags"))


@op("sc_qr_payload", "inv_header", oracle="""SELECT annotation_id, strftime(created_at, '%Y-%m-%d') AS issue_date, coalesce(CAST(total AS VARCHAR), '1.00') AS total, coalesce(CAST(vat AS VARCHAR), '0.15') AS vat FROM {inv_header}
  WHERE annotation_id % 5 <> 0 AND annotation_id % 7 <> 0 AND annotation_id % 9 <> 0""")
def sc_qr_payload(inv_header):
    p = _qr(inv_header).select("annotation_id", qr_payload(F.col("qr")).alias("p")).where("p IS NOT NULL")
    return p.select("annotation_id", "p.issue_date", "p.total", "p.vat")


@op("src_jsonl", "conversations", oracle="SELECT CASE WHEN turn % 2 = 0 THEN 'c' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) ELSE 'doc_' || lpad(CAST(conv_id * 10 + turn AS VARCHAR), 4, '0') END AS doc_key, role, text FROM {conversations}")
def src_jsonl(conversations):
    key = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")))
    lines = conversations.select((F.col("conv_id") * 10 + F.col("turn")).alias("line_no"), F.to_json(F.struct(key.alias("id"), "role", "text")).alias("value"))
    return parse_jsonl(lines, "id string, role string, text string").select("doc_key", "record.role", "record.text")


@op("src_gt_json", "fields", oracle="""SELECT CAST(annotation_id AS VARCHAR) AS document_id, field_key, value_extracted AS expected FROM {fields} WHERE row_index IS NULL AND value_extracted IS NOT NULL""")
def src_gt_json(fields):
    """Two files per document: the later one replaces the earlier."""
    cells = fields.where("row_index IS NULL AND value_extracted IS NOT NULL").groupBy("annotation_id").agg(F.map_from_entries(F.collect_list(F.struct("field_key", "value_extracted"))).alias("fields"))
    doc = F.col("annotation_id").cast("string").alias("document_id")
    new = cells.select(F.lit(2).alias("seq"), F.to_json(F.struct(doc, "fields")).alias("json"))
    old = cells.select(F.lit(1).alias("seq"), F.to_json(F.struct(doc, F.create_map(F.lit("stale"), F.lit("x")).alias("fields"))).alias("json"))
    return read_ground_truth(new.unionByName(old))


@op("sink_json", "fields", oracle="""SELECT annotation_id, count(*) AS n, count(value_extracted) AS filled FROM {fields} WHERE row_index IS NULL GROUP BY annotation_id""")
def sink_json(fields):
    """Each annotation's header as a JSON text, read back: nulls survive."""
    cells = fields.where("row_index IS NULL").groupBy("annotation_id").agg(F.collect_list(F.struct("field_key", F.col("value_extracted").alias("value"))).alias("invoice"))
    back = json_text(cells, "annotation_id", "invoice").withColumn("r", F.from_json("body", "invoice array<struct<field_key:string,value:string>>"))
    return back.select("annotation_id", F.size("r.invoice").cast("long").alias("n"), F.size(F.filter("r.invoice", lambda x: x["value"].isNotNull())).cast("long").alias("filled"))


_TEXTS = "section key label_en label_ar type value source confidence reviewed_by original_value".split()
_CSV = "annotation_id section row_index key label_en label_ar type value source confidence bbox_page reviewed_by original_value".split()


def _csv_sql(column):
    if column not in _TEXTS:
        return f"coalesce(CAST({column} AS VARCHAR), '')"
    guarded = f"CASE WHEN left({column}, 1) IN ('=', '+', '-', '@', chr(9), chr(13)) AND NOT regexp_full_match({column}, '-[0-9][0-9,]*([.][0-9]+)?') THEN chr(39) || {column} ELSE {column} END"
    return f"""coalesce(CASE WHEN regexp_matches({guarded}, '[",\\r\\n]') THEN '"' || replace({guarded}, '"', '""') || '"' ELSE {guarded} END, '')"""


@op("sink_csv", "fields", "annotations", "specs", "corrections", oracle=f"SELECT annotation_id, position, concat_ws(',', {', '.join(map(_csv_sql, _CSV))}) AS line FROM ({LONG_SQL}) e")
def sink_csv(fields, annotations, specs, corrections):
    """The long export as CSV lines: text cells guarded and quoted."""
    rows = export_rows(fields, annotations, specs, corrections)
    texts = {n for n, t in rows.dtypes if t == "string"}
    return csv_lines(rows, [c for c in rows.columns if c != "position"], texts).select("annotation_id", "position", "line")


@op("sink_xlsx", "fields", "annotations", "specs", "corrections", oracle="""SELECT f.annotation_id, CASE WHEN f.row_index IS NULL THEN 'Invoice' ELSE 'LineItems' END AS sheet, count(*) AS n, count(coalesce(f.value_final, f.value_extracted)) AS filled
  FROM {fields} f JOIN {annotations} a ON a.id = f.annotation_id WHERE a.status IN ('confirmed', 'exported') GROUP BY ALL""")
def sink_xlsx(fields, annotations, specs, corrections):
    """A workbook of two sheets for every exportable annotation, written and read back: rows and filled values of each sheet."""
    rows = export_rows(fields, annotations, specs, corrections).withColumn("sheet", F.when(F.col("section") == "invoice", "Invoice").otherwise("LineItems"))
    columns = ["row_index", "key", "label_en", "label_ar", "value", "source", "confidence"]
    cells = workbook_cells(workbooks(rows, "annotation_id", "sheet", "position", columns), "annotation_id").where("row > 0")
    per = cells.groupBy("annotation_id", "sheet").agg(F.countDistinct("row").alias("n"), F.count_if(F.col("column") == columns.index("value")).alias("filled"))
    return per


@op("sink_xlsx_batch", "fields", "annotations", oracle="""SELECT f.annotation_id, f.row_index, max(coalesce(value_final, value_extracted)) FILTER (WHERE field_key = 'quantity') AS quantity,
  max(coalesce(value_final, value_extracted)) FILTER (WHERE field_key = 'unit_price') AS unit_price, max(coalesce(value_final, value_extracted)) FILTER (WHERE field_key = 'line_amount') AS line_amount
  FROM {fields} f JOIN {annotations} a ON a.id = f.annotation_id WHERE a.status IN ('confirmed', 'exported') AND f.row_index IS NOT NULL GROUP BY ALL""")
def sink_xlsx_batch(fields, annotations):
    """The batch workbook's line sheet: a row per line, a column per key."""
    ready = annotations.where(F.col("status").isin("confirmed", "exported")).select(F.col("id").alias("annotation_id"))
    lines = fields.where("row_index IS NOT NULL").join(ready, "annotation_id", "left_semi")
    return lines.groupBy("annotation_id", "row_index").pivot("field_key", ["quantity", "unit_price", "line_amount"]).agg(F.max(effective()))


@op("sink_upsert", "fields", oracle="SELECT annotation_id, field_key, row_index, CASE WHEN annotation_id % 3 = 0 THEN 'fresh' ELSE value_extracted END AS value FROM {fields} UNION ALL SELECT DISTINCT annotation_id, 'note', CAST(NULL AS INT), 'fresh' FROM {fields} WHERE annotation_id % 3 = 0")
def sink_upsert(fields):
    """Fresh rows replace stored ones of the same key (a null row index is a key like any other), others are added."""
    stored = fields.select("annotation_id", "field_key", "row_index", F.col("value_extracted").alias("value"))
    hit = fields.where("annotation_id % 3 = 0")
    again = hit.select("annotation_id", "field_key", "row_index", F.lit("fresh").alias("value"))
    notes = hit.select("annotation_id", F.lit("note").alias("field_key"), F.lit(None).cast("int").alias("row_index"), F.lit("fresh").alias("value")).distinct()
    return upsert(stored, again.unionByName(notes), ["annotation_id", "field_key", "row_index"])


@op("sink_legacy_xlsx", "documents", oracle="SELECT doc_id, lang AS document_type, source AS company_name, CAST(n_chars AS DOUBLE) AS total_value, n_chars >= 200 AS parse_ok FROM {documents}")
def sink_legacy_xlsx(documents):
    """The flat legacy report's table, from records that are JSON texts."""
    record = F.to_json(F.struct(F.col("lang").alias("document_type"), F.col("source").alias("company_name"), F.col("n_chars").cast("double").alias("total_value")))
    r = F.from_json(record, "document_type string, company_name string, total_value double")
    return documents.select("doc_id", r.alias("r"), (F.col("n_chars") >= 200).alias("parse_ok")).select("doc_id", "r.document_type", "r.company_name", "r.total_value", "parse_ok")


@op("wn_fuse_rows", "words")
def wn_fuse_rows(words):
    """Fragments (four words each here) fused into rows where position and script allow."""
    fragment = F.floor(F.col("pos") / 4).cast("int").alias("ord")
    boxes = words.groupBy("doc_id", fragment).agg(
        F.bool_or(F.right("word", F.lit(1)).isin("e", "n")).alias("rtl"), F.min("x0").cast("double").alias("x0"), (F.min("line") * 100.0).cast("double").alias("y0"), F.max("x1").cast("double").alias("x1"), (F.min("line") * 100.0 + 80).cast("double").alias("y1")
    )
    return fuse_rows(boxes)


@op("ud_schema", "specs", oracle="SELECT field_key, position, type, required FROM {specs} WHERE position < 7")
def ud_schema(specs):
    """A field list as data: the schema's JSON document parsed into specs."""
    entry = F.struct(F.col("position"), F.col("field_key").alias("key"), "type", "label_en", "label_ar", "required")
    doc = specs.where("position < 7").agg(F.to_json(F.struct(F.array_sort(F.collect_list(entry)).alias("fields"))).alias("definition"))
    parsed = F.from_json("definition", "fields array<struct<key:string,type:string,label_en:string,label_ar:string,required:boolean>>")["fields"]
    rows = doc.select(F.posexplode(parsed).alias("position", "f"))
    return rows.select(F.col("f.key").alias("field_key"), "position", "f.type", "f.required")


_FIRST = "nullif(trim(string_split(text, ' ')[1]), '')"


@op("ud_infer", "documents", oracle=f"""SELECT doc_id, ok, CASE WHEN ok THEN CAST(len(string_split(text, ' ')) AS VARCHAR) END AS words, CASE WHEN ok AND lower({_FIRST}) NOT IN ('null', 'none', 'n/a', 'na', '-') THEN {_FIRST} END AS first,
  CAST(NULL AS VARCHAR) AS tags FROM (SELECT doc_id, text, length(text) % 5 <> 0 AS ok FROM {{documents}}) d""")
def ud_infer(documents):
    """The model seam with an injected model: replies in a code fence, every fifth no object; a list is no field text."""

    def chat(prompts):
        said = lambda p: json.dumps({"words": len(p.split(" ")), "first": p.split(" ")[0], "tags": ["x"]}, ensure_ascii=False)
        return ["```json\n" + said(p) + "\n```" if len(p) % 5 else "[1]" for p in prompts]

    return infer(documents, "doc_id", F.col("text"), chat, ["words", "first", "tags"])


@op("src_pdf_attach", "inv_header", oracle="""SELECT CAST(annotation_id AS VARCHAR) AS path, CASE WHEN annotation_id % 8 IN (0, 1, 2, 4, 5) THEN 'INV-' || annotation_id END AS number, annotation_id % 8 = 7 AS malformed FROM {inv_header}""")
def src_pdf_attach(inv_header):
    """PDFs with an invoice in the catalog's tree (by name or by content) or on a page, with a text file, with nothing, and no PDF at all; on a cluster they come from the ``binaryFile`` source."""
    k = F.col("annotation_id") % 8
    # A specification's name, and whether it hangs in the tree (and not on a page).
    name = F.when(k.isin(0, 4), "invoice.XML").when(k == 3, "notes.txt").otherwise("attachment.bin")
    body = F.when(k == 3, F.lit("plain text")).otherwise(F.concat(F.lit("<?xml version='1.0'?><Invoice><ID>INV-"), F.col("annotation_id").cast("string"), F.lit("</ID></Invoice>")))
    tree = F.when(k.isin(0, 1, 2, 3), F.concat(F.lit("/Names << /EmbeddedFiles << /Kids [ 4 0 R ] >> >>"))).otherwise(F.lit(""))
    notes = F.when(k.isin(4, 5), F.lit("/Annots [ << /Subtype /FileAttachment /FS 5 0 R >> ]")).otherwise(F.lit(""))
    pdf = F.concat(
        F.when(k == 7, "no file at all\n").otherwise("%PDF-1.7\n"), F.when(k == 7, "").otherwise(F.concat(F.lit("1 0 obj << /Type /Catalog /Pages 2 0 R "), tree, F.lit(" >> endobj\n"))),
        F.lit("2 0 obj << /Type /Pages /Kids [ 3 0 R ] >> endobj\n3 0 obj << /Type /Page "), notes, F.lit(" >> endobj\n4 0 obj << /Names [ ("), name, F.lit(") 5 0 R ] >> endobj\n5 0 obj << /Type /Filespec /UF ("),
        name, F.lit(") /EF << /F 6 0 R >> >> endobj\n6 0 obj << /Length "), F.octet_length(body).cast("string"), F.lit(" >>\nstream\n"), body, F.lit("\nendstream endobj\ntrailer << /Root 1 0 R >>\n"),
    )
    got = pdf_attachments(inv_header.select(F.col("annotation_id").cast("string").alias("path"), pdf.cast("binary").alias("content")))
    return got.select("path", F.nullif(F.regexp_extract("xml", "<ID>(.*)</ID>", 1), F.lit("")).alias("number"), "malformed")


@op("sc_hmac_token", "docs", oracle="SELECT id, CASE WHEN id % 3 = 0 THEN filename END AS payload FROM {docs}")
def sc_hmac_token(docs):
    """Tokens signed and checked again: every third is good, the others are expired or tampered with."""
    token = sign(b"secret", F.col("filename"), F.when(F.col("id") % 3 == 1, 5).otherwise(50))
    sent = F.when(F.col("id") % 3 == 2, F.concat(F.lit("x"), F.col("token"))).otherwise(F.col("token"))
    return docs.withColumn("token", token).select("id", verify(b"secret", sent, F.lit(10)).alias("payload"))


@op("ud_prune", "specs", oracle="SELECT field_key FROM {specs}")
def ud_prune(specs):
    """The seam that could select a document's relevant fields; it keeps all of them."""
    return specs.select("field_key")


def _blobs(nation, name):
    """The nations' names put below a fresh folder of the shared one, by executors; (root, keys)."""
    root = scratch_path(nation.sparkSession, name)
    key = F.concat(F.lit("region-"), F.col("n_regionkey").cast("string"), F.lit("/"), F.col("n_nationkey").cast("string"), F.lit(".txt"))
    return root, materialize(stored(nation.select(key.alias("key"), F.col("n_name").cast("binary").alias("body")), root), f"{name}-keys")


@op("src_storage", "nation", oracle="SELECT 'region-' || n_regionkey || '/' || n_nationkey || '.txt' AS key, sha256(n_name) AS digest FROM {nation}")
def src_storage(nation):
    """Blobs put by key and got again, both on the executors."""
    root, keys = _blobs(nation, "blobs")

    def get(batches):
        store = Storage(root)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([store.get(k) for k in b.column("key").to_pylist()], pa.binary())], names=["key", "body"])

    return arrow_pass(keys.select("key"), get, "key string, body binary").select("key", F.sha2("body", 256).alias("digest"))


@op("ud_storage", "nation", oracle="SELECT 'region-' || n_regionkey || '/' || n_nationkey || '.txt' AS key, n_regionkey <> 1 AS kept FROM {nation}")
def ud_storage(nation):
    """The storage seam: a prefix is deleted, the others' blobs stay."""
    root, keys = _blobs(nation, "seam")
    Storage(root).delete_prefix("region-1")

    def ask(batches):
        store = Storage(root)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([store.exists(k) for k in b.column("key").to_pylist()], pa.bool_())], names=["key", "kept"])

    return arrow_pass(keys.select("key"), ask, "key string, kept boolean")


@op("src_zip_range", "nation", oracle="SELECT 'qa/' || n_nationkey || '.json' AS name, n_name AS text FROM {nation}")
def src_zip_range(nation):
    """A zip in the shared folder, its matching entries read by ranges (the archive is made here, as the driver's tables hold none)."""
    root = scratch_path(nation.sparkSession, "archive")
    target = io.BytesIO()
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for r in nation.select("n_nationkey", "n_name").toLocalIterator():
            z.writestr(f"qa/{r.n_nationkey}.json", r.n_name)
            z.writestr(f"images/{r.n_nationkey}.jpg", b"no text")
    Storage(root).put("corpus.zip", target.getvalue())
    return zip_entries(nation.sparkSession, f"{root}/corpus.zip", r"qa/.*[.]json").select("name", F.col("content").cast("string").alias("text"))
