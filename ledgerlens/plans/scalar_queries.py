"""Scalar functions over the driver's tables: money, dates, numbers, labels, formats and keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions import scalars as S
from ledgerlens.plans.catalog import op

ARABIC_INDIC = "".join(chr(0x660 + i) for i in range(10))


def _arabic_digits(c):
    return F.translate(c, "0123456789", ARABIC_INDIC)


_AR = f"translate({{c}}, '0123456789', '{ARABIC_INDIC}')"


@op("sc_numerals", "orders", oracle="SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) || '/' || CAST(o_custkey AS VARCHAR) AS folded FROM {orders}")
def sc_numerals(orders):
    printed = F.concat_ws("/", _arabic_digits(F.col("o_orderkey").cast("string")), _arabic_digits(F.col("o_custkey").cast("string")))
    return orders.select("o_orderkey", S.numerals(printed).alias("folded"))


@op("sc_has_arabic", "page_texts", oracle="SELECT annotation_id, annotation_id % 50 IN (0, 1) AND annotation_id % 40 <> 9 AS arabic FROM {page_texts}")
def sc_has_arabic(page_texts):
    return page_texts.select("annotation_id", S.has_arabic(F.col("page_text")).alias("arabic"))


@op("sc_presentation", "customer", oracle="SELECT c_custkey, c_custkey % 5 = 0 AS shaped FROM {customer}")
def sc_presentation(customer):
    """Shaped glyphs (here put before every fifth name) call for NFKC folding."""
    name = F.concat(F.when(F.col("c_custkey") % 5 == 0, F.lit("\ufee3")).otherwise(F.lit("\u0645")), F.col("c_name"))
    return customer.select("c_custkey", S.has_presentation_forms(name).alias("shaped"))


@op("sc_normalize", "customer", oracle="SELECT c_custkey, CAST(c_custkey AS VARCHAR) || ' ' || chr(1605) || '-' || c_name || ' x' AS normal FROM {customer}")
def sc_normalize(customer):
    """NFKC, digits, dashes, spaces and invisible characters folded: a decorated text comes back plain."""
    decorated = F.concat(_arabic_digits(F.col("c_custkey").cast("string")), F.lit("\u00a0\u200b\ufee3\u2013"), F.col("c_name"), F.lit(" \t x\u200f"))
    return customer.select("c_custkey", S.canonical(decorated).alias("normal"))


@op("sc_orthography", "customer", oracle="SELECT c_custkey, chr(1575) || chr(1575) || chr(1610) || chr(1607) || c_mktsegment AS folded FROM {customer}")
def sc_orthography(customer):
    return customer.select("c_custkey", S.fold_orthography(F.concat(F.lit("أآىة"), F.col("c_mktsegment"))).alias("folded"))


@op("sc_match_form", "documents", oracle="SELECT doc_id, replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 'ß', 'ss') AS form FROM {documents}")
def sc_match_form(documents):
    """Folded for comparing: case folding also turns ß into ss, which lower() doesn't."""
    return documents.select("doc_id", S.match_form(F.col("text")).alias("form"))


@op("sc_squash", "documents", oracle="SELECT doc_id, regexp_replace(text, '\\s+', '', 'g') AS squashed FROM {documents}")
def sc_squash(documents):
    return documents.select("doc_id", S.squash(F.col("text")).alias("squashed"))


_PRICE = "CASE o_orderkey % 6 WHEN 0 THEN format('{:,.2f}', o_totalprice) WHEN 1 THEN ' ' || CAST(o_totalprice AS VARCHAR) || ' ' WHEN 2 THEN '' WHEN 3 THEN 'SAR' WHEN 4 THEN '-' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) ELSE CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR) END"


def _price():
    k, p = F.col("o_orderkey") % 6, F.col("o_totalprice")
    cents = p.cast("decimal(18,2)").cast("string")
    return (
        F.when(k == 0, F.format_number(p.cast("decimal(18,2)"), 2)).when(k == 1, F.concat(F.lit(" "), cents, F.lit(" "))).when(k == 2, "").when(k == 3, "SAR")
        .when(k == 4, F.concat(F.lit("-"), cents)).otherwise(F.round(p, 0).cast("bigint").cast("string"))
    )


@op("sc_to_decimal", "orders", oracle="""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN -CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) WHEN 5 THEN CAST(round(o_totalprice, 0) AS DOUBLE)
  ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) END AS amount FROM {orders}""")
def sc_to_decimal(orders):
    """Grouped, padded, blank, worded, negative and whole amounts as decimals; no number: null."""
    return orders.select("o_orderkey", S.to_decimal(_price()).cast("double").alias("amount"))


@op("sc_ubl_decimal", "orders", oracle="SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS amount FROM {orders}")
def sc_ubl_decimal(orders):
    return orders.select("o_orderkey", S.to_decimal(F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2)).cast("double").alias("amount"))


@op("sc_money", "lineitem", oracle="SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round_even(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)), 2) AS DOUBLE) AS cents FROM {lineitem}")
def sc_money(lineitem):
    """Two decimals, halves to the even neighbour."""
    value = F.col("l_extendedprice").cast("decimal(18,2)") * F.col("l_discount").cast("decimal(4,2)")
    return lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.money(value).cast("double").alias("cents"))


@op("sc_close_enough", "inv_header", oracle="SELECT annotation_id, abs(round_even(subtotal + vat, 2) - round_even(total, 2)) <= 0.01 AS close FROM {inv_header}")
def sc_close_enough(inv_header):
    return inv_header.select("annotation_id", S.close_enough(F.col("subtotal") + F.col("vat"), F.col("total")).alias("close"))


@op("sc_to_date", "orders", oracle="SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 3 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM {orders}")
def sc_to_date(orders):
    """ISO timestamps, day-first dates in three styles, an unreal date, and Arabic digits."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    text = (
        F.when(k == 0, F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T10:00:00Z"))).when(k == 1, F.date_format(d, "dd/MM/yyyy")).when(k == 2, F.date_format(d, "d.M.yyyy"))
        .when(k == 3, F.lit("2024-02-30")).otherwise(_arabic_digits(F.date_format(d, "dd-MM-yyyy")))
    )
    return orders.select("o_orderkey", S.to_date(text).alias("day"))


@op("sc_ubl_date", "orders", oracle="SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 1 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM {orders}")
def sc_ubl_date(orders):
    text = F.when(F.col("o_orderkey") % 4 == 1, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return orders.select("o_orderkey", S.iso_date(text).alias("day"))


@op("sc_ubl_time", "events", oracle="SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE strftime(ts, '%H:%M:%S') END AS at FROM {events}")
def sc_ubl_time(events):
    k, t = F.col("event_id") % 3, F.date_format("ts", "HH:mm:ss")
    return events.select("event_id", S.ubl_time(F.when(k == 0, F.concat(t, F.lit("Z"))).when(k == 1, t).otherwise("25:61")).alias("at"))


@op("sc_same_value", "fields", oracle="""SELECT annotation_id, field_key, row_index, CASE WHEN field_key IN ('subtotal', 'vat_amount', 'total_amount') AND TRY_CAST(value_extracted AS DECIMAL(38,10)) IS NOT NULL AND TRY_CAST(shadow_value AS DECIMAL(38,10)) IS NOT NULL
  THEN TRY_CAST(value_extracted AS DECIMAL(38,10)) = TRY_CAST(shadow_value AS DECIMAL(38,10)) ELSE lower(value_extracted) = lower(shadow_value) END AS same FROM {fields} WHERE row_index IS NULL""")
def sc_same_value(fields):
    from ledgerlens.operators.rules import same_value

    numeric = F.col("field_key").isin("subtotal", "vat_amount", "total_amount")
    return fields.where("row_index IS NULL").select("annotation_id", "field_key", "row_index", same_value(F.col("value_extracted"), F.col("shadow_value"), numeric).alias("same"))


@op("sc_trn_valid", "inv_header", oracle="SELECT annotation_id, coalesce(length(seller_trn) = 15, false) AS seller_ok, coalesce(right(buyer_trn, 1) = '3', false) AS buyer_ok FROM {inv_header}")
def sc_trn_valid(inv_header):
    spaced = F.concat(F.substring("seller_trn", 1, 3), F.lit(" "), F.substring("seller_trn", 4, 20), F.lit("-"))
    return inv_header.select("annotation_id", S.trn_valid(spaced).alias("seller_ok"), S.trn_valid(F.col("buyer_trn")).alias("buyer_ok"))


@op("sc_trn_type", "inv_header", oracle="SELECT annotation_id, CASE WHEN length(seller_trn) = 15 THEN right(seller_trn, 2) END AS type FROM {inv_header}")
def sc_trn_type(inv_header):
    return inv_header.select("annotation_id", S.trn_type(F.col("seller_trn")).alias("type"))


@op("sc_qr_date", "orders", oracle="SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM {orders}")
def sc_qr_date(orders):
    stamp = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).otherwise("no date")
    return orders.select("o_orderkey", S.qr_date(stamp).alias("day"))


@op("sc_digits", "documents", oracle="SELECT doc_id, regexp_replace(text, '[^0-9]', '', 'g') AS digits FROM {documents}")
def sc_digits(documents):
    return documents.select("doc_id", S.digits(F.col("text")).alias("digits"))


@op("sc_numbers_in", "documents", oracle="""SELECT doc_id, len(list_distinct(list_filter(list_transform(regexp_extract_all(text, '[0-9][0-9,]*(?:[.][0-9]+)?'), lambda x: TRY_CAST(replace(x, ',', '') AS DECIMAL(38,10))), lambda x: x IS NOT NULL))) AS n FROM {documents}""")
def sc_numbers_in(documents):
    return documents.select("doc_id", F.size(S.numbers_in(F.col("text"))).cast("long").alias("n"))


@op("sc_mojibake", "documents", oracle="""SELECT doc_id, contains(text, chr(65533)) OR length(regexp_replace(text, '[^' || chr(128) || '-' || chr(591) || ']', '', 'g')) >= greatest(2, length(text) // 3) AS broken FROM {documents}""")
def sc_mojibake(documents):
    return documents.select("doc_id", S.mojibake(F.col("text")).alias("broken"))


@op("sc_label_present", "page_texts", oracle="""SELECT annotation_id, CASE WHEN page_text = '' THEN NULL WHEN contains(page_text, 'Total ') THEN 'Total ' ELSE 'Invoice' END AS label FROM {page_texts}""")
def sc_label_present(page_texts):
    """Labels in order; the plural of the Arabic one doesn't count, and a short label never does."""
    labels = F.array(F.lit("PO"), F.lit("الفواتير"), F.lit("Total "), F.lit("Invoice"))
    return page_texts.select("annotation_id", S.label_present(labels, F.regexp_replace("page_text", "Subtotal", "Sub-sum")).alias("label"))


@op("sc_search_labels", "specs", oracle="""SELECT field_key, array_to_string(CASE field_key WHEN 'seller_name' THEN ['Seller name (legal)', 'اسم البائع', 'البائع', 'Seller name', 'syn'] WHEN 'unit_price' THEN ['سعر الوحدة', 'syn'] ELSE [label_en, label_ar, 'syn'] END, '|') AS labels FROM {specs}""")
def sc_search_labels(specs):
    return specs.select("field_key", F.array_join(S.search_labels(F.col("label_en"), F.col("label_ar"), F.array(F.lit("syn "), F.lit(""))), "|").alias("labels"))


@op("sc_fragmented", "page_texts", oracle="SELECT annotation_id, annotation_id % 50 = 0 AND annotation_id % 40 <> 9 AS shattered FROM {page_texts}")
def sc_fragmented(page_texts):
    return page_texts.select("annotation_id", S.fragmented(F.col("page_text")).alias("shattered"))


@op("sc_needs_vision", "page_texts", oracle="SELECT annotation_id, page_text = '' OR annotation_id % 50 = 0 AS vision FROM {page_texts}")
def sc_needs_vision(page_texts):
    degraded = F.length(F.trim("page_text")) < 8
    return page_texts.select("annotation_id", (degraded | S.fragmented(F.col("page_text"))).alias("vision"))


@op("sc_coerce", "events", oracle="""SELECT event_id, CASE event_id % 8 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN 'text' WHEN 2 THEN 'true' WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 5 THEN NULL WHEN 6 THEN NULL ELSE 'a b' END AS value FROM {events}""")
def sc_coerce(events):
    """Numbers and booleans as text; null words, lists and objects as null."""
    k = F.col("event_id") % 8
    raw = (
        F.when(k == 0, F.col("event_id").cast("string")).when(k == 1, '" text "').when(k == 2, "true").when(k == 3, "null").when(k == 4, '"N/A"')
        .when(k == 5, "[1, 2]").when(k == 6, '{"a": 1}').otherwise('"a b"')
    )
    return events.select("event_id", S.coerce_json(raw).alias("value"))


@op("sc_json_reply", "events", oracle="SELECT event_id, CASE WHEN event_id % 3 < 2 THEN props END AS body FROM {events}")
def sc_json_reply(events):
    """An object, bare or in a code fence; anything else is refused."""
    k = F.col("event_id") % 3
    reply = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))).otherwise(F.concat(F.lit("["), F.col("props"), F.lit("]")))
    return events.select("event_id", S.json_reply(reply).alias("body"))


@op("sc_json_block", "events", oracle="SELECT event_id, CASE WHEN event_id % 2 = 0 THEN props END AS block FROM {events}")
def sc_json_block(events):
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Here: "), F.col("props"), F.lit(" done"))).otherwise("{broken")
    return events.select("event_id", S.json_block(text).alias("block"))


@op("sc_flatten_legacy", "part", oracle="SELECT p_partkey, p_name, replace(p_name, ' ', '; ') AS equipment, p_size > 0 AS parse_ok FROM {part}")
def sc_flatten_legacy(part):
    return part.select("p_partkey", "p_name", F.array_join(F.split("p_name", " "), "; ").alias("equipment"), (F.col("p_size") > 0).alias("parse_ok"))


@op("sc_looks_xml", "docs", oracle="SELECT id, id % 3 = 0 OR id % 4 = 0 AS xml FROM {docs}")
def sc_looks_xml(docs):
    name = F.when(F.col("id") % 3 == 0, F.replace("filename", F.lit(".pdf"), F.lit(".XML"))).otherwise(F.col("filename"))
    head = F.when(F.col("id") % 4 == 0, F.lit('\ufeff <?xml version="1.0"?><a/>')).otherwise("%PDF-1.7")
    return docs.select("id", S.looks_xml(name, head).alias("xml"))


@op("sc_is_pdf", "docs", oracle="SELECT id, id % 3 <> 2 AS pdf FROM {docs}")
def sc_is_pdf(docs):
    k = F.col("id") % 3
    head = F.when(k == 0, "%PDF-1.4").when(k == 1, F.concat(F.lit("junk" * 10), F.lit("%PDF-"))).otherwise(F.concat(F.lit("x" * 1024), F.lit("%PDF-")))
    return docs.select("id", S.is_pdf(head).alias("pdf"))


@op("sc_safe_filename", "docs", oracle="SELECT id, CASE WHEN id % 3 = 2 THEN NULL ELSE filename END AS name FROM {docs}")
def sc_safe_filename(docs):
    k = F.col("id") % 3
    name = F.when(k == 0, F.concat(F.lit("../../a/"), F.col("filename"))).when(k == 1, F.concat(F.lit("C:\\x\\"), F.col("filename"), F.lit("\u0007"))).otherwise("dir/")
    return docs.select("id", S.safe_filename(name).alias("name"))


@op("sc_sha256", "documents", oracle="SELECT doc_id, sha256(text) AS digest FROM {documents}")
def sc_sha256(documents):
    return documents.select("doc_id", F.sha2("text", 256).alias("digest"))


@op("sc_storage_key", "docs", oracle="SELECT id, id % 4 IN (0, 1) AS ok FROM {docs}")
def sc_storage_key(docs):
    k = F.col("id") % 4
    key = F.when(k == 0, F.concat(F.lit("org/"), F.col("id").cast("string"), F.lit("/page-1.webp"))).when(k == 1, "a..b/c").when(k == 2, "a/../b").otherwise("/etc/x")
    return docs.select("id", S.storage_key_ok(key).alias("ok"))


@op("sc_csvguard", "orders", oracle="SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '''=1+1' WHEN 1 THEN '''+SUM(A1)' WHEN 2 THEN '''@cmd' WHEN 3 THEN '''-1+1' WHEN 4 THEN '-45,320.00' ELSE o_orderstatus END AS cell FROM {orders}")
def sc_csvguard(orders):
    k = F.col("o_orderkey") % 6
    cell = F.when(k == 0, "=1+1").when(k == 1, "+SUM(A1)").when(k == 2, "@cmd").when(k == 3, "-1+1").when(k == 4, "-45,320.00").otherwise(F.col("o_orderstatus"))
    return orders.select("o_orderkey", S.csv_guard(cell).alias("cell"))


@op("sc_export_cell", "lineitem", oracle="SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST(round_even(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2)), 2) AS DECIMAL(38,2)) AS VARCHAR) AS cell, l_returnflag AS kept FROM {lineitem}")
def sc_export_cell(lineitem):
    value = (F.col("l_extendedprice").cast("decimal(18,2)") * F.col("l_tax").cast("decimal(4,2)")).cast("string")
    return lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.export_cell(F.lit("decimal"), value).alias("cell"), S.export_cell(F.lit("decimal"), F.col("l_returnflag")).alias("kept"))


@op("sc_format_money", "orders", oracle="SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN chr(8212) WHEN 1 THEN 'n/a' ELSE format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) || '.50' END AS shown FROM {orders}")
def sc_format_money(orders):
    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, "").when(k == 1, "n/a").otherwise(F.concat(F.floor("o_totalprice").cast("string"), F.lit(".50")))
    return orders.select("o_orderkey", S.format_money(text).alias("shown"))


@op("sc_format_elapsed", "documents", oracle="SELECT doc_id, CAST(n_chars // 60 AS VARCHAR) || ':' || lpad(CAST(n_chars % 60 AS VARCHAR), 2, '0') AS elapsed FROM {documents}")
def sc_format_elapsed(documents):
    return documents.select("doc_id", S.format_elapsed(F.col("n_chars")).alias("elapsed"))


@op("sc_format_bytes", "documents", oracle="SELECT doc_id, CASE WHEN n_chars < 1024 THEN CAST(n_chars AS VARCHAR) || ' B' ELSE CAST(CAST(floor(n_chars / 1024 + 0.5) AS BIGINT) AS VARCHAR) || ' KB' END AS size FROM {documents}")
def sc_format_bytes(documents):
    return documents.select("doc_id", S.format_bytes(F.col("n_chars")).alias("size"))


@op("sc_initials", "part", oracle="SELECT p_partkey, upper(substr(string_split(p_name, ' ')[1], 1, 1) || substr(string_split(p_name, ' ')[2], 1, 1)) AS initials FROM {part}")
def sc_initials(part):
    return part.select("p_partkey", S.initials(F.col("p_name")).alias("initials"))


@op("sc_format_datetime", "orders", oracle="SELECT o_orderkey, strftime(o_orderdate, '%b') || ' ' || CAST(day(o_orderdate) AS VARCHAR) || ', ' || strftime(o_orderdate, '%Y') AS shown FROM {orders}")
def sc_format_datetime(orders):
    return orders.select("o_orderkey", F.date_format("o_orderdate", "MMM d, yyyy").alias("shown"))


@op("sc_interpolate", "orders", oracle="SELECT o_orderkey, 'Order ' || CAST(o_orderkey AS VARCHAR) || ' of ' || CAST(o_custkey AS VARCHAR) || ' {unknown}' AS text FROM {orders}".replace("{unknown}", "' || chr(123) || 'unknown' || chr(125) || '"))
def sc_interpolate(orders):
    return orders.select("o_orderkey", S.interpolate(F.lit("Order {key} of {cust} {unknown}"), {"key": F.col("o_orderkey"), "cust": F.col("o_custkey")}).alias("text"))


@op("sc_label_for", "specs", oracle="SELECT field_key, CASE WHEN label_en <> '' THEN label_en ELSE label_ar END AS label, upper(substr(field_key, 1, 1)) || replace(substr(field_key, 2), '_', ' ') AS bare FROM {specs}")
def sc_label_for(specs):
    none = F.lit(None).cast("string")
    return specs.select("field_key", S.label_for(F.col("label_en"), F.col("label_ar"), F.col("field_key")).alias("label"), S.label_for(none, none, F.col("field_key")).alias("bare"))


@op("sc_numeric_like", "fields", oracle="SELECT annotation_id, field_key, row_index, coalesce(field_key IN ('subtotal', 'vat_amount') OR (regexp_matches(value_extracted, '[0-9]') AND length(value_extracted) = strlen(value_extracted)), false) AS numeric_like FROM {fields}")
def sc_numeric_like(fields):
    kind = F.when(F.col("field_key").isin("subtotal", "vat_amount"), "decimal").otherwise("string")
    return fields.select("annotation_id", "field_key", "row_index", S.numeric_like(kind, F.col("value_extracted")).alias("numeric_like"))


@op("sc_bbox_union", "words", oracle="SELECT doc_id, line, CAST(min(x0) AS DOUBLE) AS x0, CAST(max(x1) AS DOUBLE) AS x1 FROM {words} GROUP BY doc_id, line")
def sc_bbox_union(words):
    box = F.struct(F.col("x0").cast("double").alias("x0"), F.lit(0.0).alias("y0"), F.col("x1").cast("double").alias("x1"), F.lit(1.0).alias("y1"))
    joined = words.groupBy("doc_id", "line").agg(S.bbox_union(F.collect_list(box)).alias("b"))
    return joined.select("doc_id", "line", "b.x0", "b.x1")


@op("sc_bucket", "words", oracle="""SELECT doc_id, pos, CASE WHEN r < 0.05 THEN '<0.05' WHEN r < 0.10 THEN '<0.10' WHEN r < 0.15 THEN '<0.15' WHEN r < 0.20 THEN '<0.20' WHEN r < 0.30 THEN '<0.30' WHEN r < 0.50 THEN '<0.50' WHEN r < 1.00 THEN '<1.00' ELSE '>=1.00' END AS bucket
  FROM (SELECT doc_id, pos, CAST((pos * 7) % 25 AS DOUBLE) / 20 AS r FROM {words}) t""")
def sc_bucket(words):
    return words.select("doc_id", "pos", S.bucket(((F.col("pos") * 7) % 25).cast("double") / 20).alias("bucket"))


@op("sc_question_norm", "conversations", oracle="SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(text), '[^\\w\\sß-ÿœæ]', ' ', 'g'), '\\s+', ' ', 'g')) AS question FROM {conversations}")
def sc_question_norm(conversations):
    return conversations.select("conv_id", "turn", S.question_norm(F.col("text")).alias("question"))


@op("sc_field_for", "conversations", oracle="SELECT conv_id, turn, ['seller_name', 'issue_date', 'total_amount', 'subtotal', 'vat_amount', 'seller_trn', 'invoice_number', NULL, NULL, NULL][(conv_id * 3 + turn) % 10 + 1] AS field FROM {conversations}")
def sc_field_for(conversations):
    """One question for each field, and three lookalikes that ask for none."""
    texts = ("What is the pharmacy name?", "when  was the PURCHASE made", "What was the grand total?", "What is the total before tax?", "What is the VAT value?", "what is the VAT registration number?", "What is the bill no.?",
             "What is the name of the company?", "What is the order number?", "what is the total weight")
    asked = F.element_at(F.array(*map(F.lit, texts)), ((F.col("conv_id") * 3 + F.col("turn")) % 10 + 1).cast("int"))
    return conversations.select("conv_id", "turn", S.field_for(asked).alias("field"))
