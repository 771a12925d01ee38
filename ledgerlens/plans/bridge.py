"""Bridge views: the document engine's tables, derived from the star-schema tables.

Each view is one SQL text that both Spark and DuckDB understand; ``{name}`` names
a table or another view, and ``EXPLODE[...]`` a dialect's list expansion. Spark gets
them as DataFrames (lazy, so Catalyst prunes and pushes down through them); DuckDB
gets the same text as common table expressions in front of an oracle query.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.session import TABLES, materialize, table

#: The instant that stands for the present; results never depend on the wall clock.
AS_OF = "TIMESTAMP '1998-01-01 01:00:00'"
STALLED_AFTER_S = 900

STATUSES = "importing to_review reviewing confirmed approved exporting exported rejected failed postponed".split()
HEADER_KEYS = "invoice_number issue_date seller_name seller_trn buyer_trn subtotal vat_amount total_amount currency".split()
LINE_KEYS = "quantity unit_price line_amount".split()


def _list(names: list[str]) -> str:
    return "EXPLODE[" + ", ".join(f"'{n}'" for n in names) + "]"


def _case(key: str, names: list[str]) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"


VIEWS: dict[str, str] = {
    # One row per invoice line; row_index counts from 0 in a total order of the line's columns.
    "inv_lines": """
        SELECT l_orderkey AS annotation_id,
               CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS INT) AS row_index,
               CAST(l_quantity AS DECIMAL(9,2)) AS quantity,
               CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE CAST(l_extendedprice AS DECIMAL(12,2)) END AS unit_price,
               CASE WHEN l_suppkey % 7 = 0 THEN NULL
                    WHEN l_suppkey % 7 = 1 THEN CAST(CAST(l_quantity AS DECIMAL(9,2)) * CAST(l_extendedprice AS DECIMAL(12,2)) + 0.02 AS DECIMAL(22,2))
                    ELSE CAST(CAST(l_quantity AS DECIMAL(9,2)) * CAST(l_extendedprice AS DECIMAL(12,2)) AS DECIMAL(22,2)) END AS line_amount
        FROM {lineitem}""",
    "inv_sums": """
        SELECT annotation_id, CAST(sum(coalesce(quantity * unit_price, line_amount)) AS DECIMAL(30,2)) AS line_sum,
               count(coalesce(quantity * unit_price, line_amount)) AS usable
        FROM {inv_lines} GROUP BY annotation_id""",
    # One row per invoice with amounts and deterministic faults. The sums, a row per invoice too, are already dealt by
    # invoice: merged there, what reads the headers runs on all partitions, however few files the orders have.
    "inv_header": """
        SELECT /*+ MERGE(s) */ o_orderkey AS annotation_id, o_custkey AS document_id, o_orderdate AS created_at,
               CASE WHEN o_orderkey % 17 = 3 THEN NULL WHEN o_orderkey % 19 = 4 THEN s.line_sum + 0.02 ELSE s.line_sum END AS subtotal,
               CASE WHEN o_orderkey % 11 = 0 THEN NULL
                    WHEN o_orderkey % 29 = 5 THEN CAST(-1.00 AS DECIMAL(30,2))
                    ELSE CAST(s.line_sum * 0.15 AS DECIMAL(30,2)) END AS vat,
               CASE WHEN o_orderkey % 23 = 6 THEN s.line_sum
                    WHEN o_orderkey % 7 = 0 THEN CAST(s.line_sum * 1.15 + 0.05 AS DECIMAL(30,2))
                    ELSE CAST(s.line_sum * 1.15 AS DECIMAL(30,2)) END AS total,
               CASE o_orderkey % 7 WHEN 0 THEN 'Z' WHEN 1 THEN ' s ' WHEN 2 THEN 'E' WHEN 3 THEN 'O' WHEN 4 THEN 'Q' WHEN 5 THEN NULL ELSE 'S' END AS vat_category,
               CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN CAST(0 AS DECIMAL(9,2)) ELSE CAST(15 AS DECIMAL(9,2)) END AS vat_percent,
               CASE WHEN o_orderkey % 37 = 0 THEN '381' ELSE '388' END AS type_code,
               CASE WHEN o_orderkey % 3 = 0 THEN '0200000' ELSE '0100000' END AS type_name,
               CASE WHEN o_custkey % 9 = 0 THEN NULL
                    WHEN o_custkey % 9 = 1 THEN concat('3', lpad(CAST(o_custkey AS STRING), 12, '1'), '3')
                    WHEN o_custkey % 9 = 2 THEN concat('3', lpad(CAST(o_custkey AS STRING), 13, '1'), '3')
                    ELSE concat('3', lpad(CAST(o_custkey AS STRING), 12, '1'), '03') END AS seller_trn,
               CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE concat('3', lpad(CAST(o_orderkey AS STRING), 12, '2'), '0', CAST(3 + o_orderkey % 2 AS STRING)) END AS buyer_trn,
               o_orderkey % 4 < 2 AS has_ubl, o_orderkey % 6 <> 0 AS has_icv, o_orderkey % 9 <> 0 AS has_pih,
               CASE WHEN o_orderkey % 8 = 0 THEN CAST(CAST(s.line_sum * 1.15 AS DECIMAL(30,2)) AS STRING) END AS qr_total,
               CASE WHEN o_orderkey % 8 = 0 THEN CAST(CAST(s.line_sum * 0.15 AS DECIMAL(30,2)) AS STRING) END AS qr_vat,
               o_orderstatus, o_custkey, o_orderpriority
        FROM {orders} LEFT JOIN {inv_sums} s ON s.annotation_id = o_orderkey""",
    # Entity-attribute-value rows; header cells have a null row_index.
    "field_cells": f"""
        SELECT annotation_id, field_key, CAST(NULL AS INT) AS row_index,
               CASE field_key WHEN 'invoice_number' THEN concat('INV-', CAST(annotation_id AS STRING))
                    WHEN 'issue_date' THEN CAST(CAST(created_at AS DATE) AS STRING)
                    WHEN 'seller_name' THEN CASE WHEN o_custkey % 10 = 0 THEN 'ÙÙØ³Ø' ELSE concat('Seller ', CAST(o_custkey AS STRING)) END
                    WHEN 'seller_trn' THEN seller_trn WHEN 'buyer_trn' THEN buyer_trn
                    WHEN 'subtotal' THEN CAST(subtotal AS STRING) WHEN 'vat_amount' THEN CAST(vat AS STRING)
                    WHEN 'total_amount' THEN CAST(total AS STRING) ELSE 'SAR' END AS value,
               annotation_id * 31 + length(field_key) * 7 AS seed
        FROM (SELECT *, {_list(HEADER_KEYS)} AS field_key FROM {{inv_header}}) h
        UNION ALL
        SELECT annotation_id, field_key, row_index,
               CASE field_key WHEN 'quantity' THEN CAST(quantity AS STRING) WHEN 'unit_price' THEN CAST(unit_price AS STRING)
                    ELSE CAST(line_amount AS STRING) END AS value,
               annotation_id * 31 + length(field_key) * 7 + row_index AS seed
        FROM (SELECT *, {_list(LINE_KEYS)} AS field_key FROM {{inv_lines}}) l""",
    "fields": """
        SELECT annotation_id, field_key, row_index,
               CASE WHEN seed % 13 = 5 THEN NULL ELSE value END AS value_extracted,
               CASE WHEN seed % 10 = 3 THEN value || '9' WHEN seed % 10 = 4 THEN value END AS value_final,
               CASE seed % 7 WHEN 0 THEN 'ubl_xml' WHEN 1 THEN 'human' WHEN 2 THEN 'computed' WHEN 3 THEN 'qr' WHEN 4 THEN 'ocr_rule' ELSE 'vlm' END AS source,
               CASE seed % 5 WHEN 0 THEN 'blocking' WHEN 1 THEN 'auto_validated' WHEN 2 THEN 'auto_validated' ELSE 'review_suggested' END AS validation_state,
               CASE WHEN seed % 9 = 2 THEN value || '.00' WHEN seed % 9 < 5 THEN value END AS shadow_value,
               CAST((seed % 101) * 0.01 AS DECIMAL(5,4)) AS confidence,
               CASE WHEN seed % 6 <> 0 THEN CAST(1 + seed % 3 AS INT) END AS bbox_page
        FROM {field_cells}""",
    "docs": """
        SELECT c_custkey AS id, c_mktsegment AS org_id, c_nationkey AS queue_id, concat(c_name, '.pdf') AS filename,
               c_custkey % 3 = 0 AS has_embedded_ubl, CAST(1 + c_custkey % 4 AS INT) AS page_count,
               TIMESTAMP '1998-01-01 00:00:00' + INTERVAL '1' SECOND * CAST(c_custkey % 3600 AS INT) AS created_at
        FROM {customer}""",
    # How each page's text was got; which pages fail is made up but fixed.
    "page_reads": """
        SELECT document_id, page, CASE (document_id * 3 + page) % 7 WHEN 0 THEN 'ocr_unsupported_script' WHEN 1 THEN 'empty' WHEN 2 THEN 'ocr_unavailable' WHEN 3 THEN 'ocr' ELSE 'text_layer' END AS source
        FROM {doc_pages}""",
    "annotations": f"""
        SELECT o_orderkey AS id, o_custkey AS document_id, o_orderdate AS created_at,
               {_case("o_orderkey % 10", STATUSES)} AS status,
               CASE WHEN o_orderkey % 4 <> 0 THEN 'model-1' END AS model_version,
               CASE WHEN o_orderkey % 10 IN (3, 6) THEN o_custkey % 5 END AS confirmed_by,
               o_orderkey % 20 AS schema_id, o_orderkey % 2 = 0 AS automated
        FROM {{orders}}""",
    "findings": """
        SELECT l_orderkey AS annotation_id,
               CASE l_linenumber % 5 WHEN 0 THEN 'PIPELINE_FAILED' WHEN 1 THEN 'GRAND_TOTAL_MISMATCH' WHEN 2 THEN 'TRN_FORMAT'
                    WHEN 3 THEN 'QR_TOTAL_MATCH' ELSE 'REQUIRED_FIELD_MISSING' END AS rule_code,
               CASE WHEN l_linenumber % 5 = 4 THEN 'warning' ELSE 'error' END AS severity,
               l_partkey % 3 = 0 AS passed,
               concat('finding ', CAST(l_partkey AS STRING)) AS message_en,
               CASE l_linenumber % 5 WHEN 1 THEN 'total_amount' WHEN 2 THEN 'seller_trn' WHEN 4 THEN 'issue_date' END AS field_key,
               l_linenumber AS line_no, l_partkey AS part_no, l_suppkey AS supp_no
        FROM {lineitem}""",
    "corrections": f"""
        SELECT event_id AS id, user_id AS annotation_id, ts AS created_at,
               {_case("event_id % 9", HEADER_KEYS)} AS field_key,
               CAST(CASE WHEN event_id % 4 = 1 THEN 0 END AS INT) AS row_index,
               CASE WHEN event_type = 'error' THEN 'delete' ELSE 'set' END AS action,
               CAST(value AS STRING) AS new_value,
               CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 5 END AS user_id
        FROM {{events}}""",
    "schemas": """
        SELECT p_partkey AS id, CASE WHEN p_partkey % 31 = 0 THEN NULL ELSE p_brand END AS queue_id, p_size AS version,
               concat(p_name, ' schema') AS name
        FROM {part}""",
    "queues": "SELECT DISTINCT p_brand AS id, concat('Queue ', p_brand) AS name FROM {part} WHERE p_brand <> 'Brand#7'",
    # What an invoice's page prints: true amounts, and for some invoices shattered or whole Arabic words.
    "page_texts": """
        SELECT annotation_id, CASE WHEN annotation_id % 40 = 9 THEN '' ELSE concat('Invoice INV-', CAST(annotation_id AS STRING), ' Subtotal ', coalesce(CAST(subtotal AS STRING), '-'),
               ' VAT ', coalesce(CAST(vat AS STRING), '-'), CASE WHEN annotation_id % 3 = 1 THEN concat(' Total ', coalesce(CAST(total AS STRING), '-'), '0') ELSE '' END,
               CASE annotation_id % 50 WHEN 0 THEN concat(' ', repeat('م ', 30)) WHEN 1 THEN concat(' ', repeat('المشتري ', 30)) ELSE '' END) END AS page_text
        FROM {inv_header}""",
    "specs": f"""
        SELECT field_key, CAST(position AS INT) AS position, label_en, label_ar, type, required FROM (VALUES
          ('invoice_number', 0, 'Invoice number', 'رقم الفاتورة', 'string', true), ('issue_date', 1, 'Issue date', 'تاريخ الإصدار', 'date', true),
          ('seller_name', 2, 'Seller name (legal)', 'اسم البائع', 'string', true), ('seller_trn', 3, 'Seller VAT number', 'الرقم الضريبي للبائع', 'string', true),
          ('subtotal', 4, 'Subtotal', 'المجموع', 'decimal', true), ('vat_amount', 5, 'VAT amount', 'مبلغ الضريبة', 'decimal', true),
          ('total_amount', 6, 'Total', 'الإجمالي', 'decimal', true), ('quantity', 7, 'Quantity', 'الكمية', 'decimal', false),
          ('unit_price', 8, '', 'سعر الوحدة', 'decimal', false)) AS t(field_key, position, label_en, label_ar, type, required)""",
    # Scored predictions: one row per run, document and field.
    "outcomes": """
        SELECT run, doc_id, field, status, rule_flagged, shown_green, producer, path FROM (
          SELECT run, l.doc_id, d.lang AS field, d.source AS producer,
                 CASE WHEN d.n_chars % 2 = 0 THEN 'vision' ELSE 'text' END AS path,
                 CASE WHEN l.quality = 1 AND (l.doc_id + run) % 5 <> 0 THEN 'correct' WHEN (l.doc_id + run) % 3 = 0 THEN 'missing' ELSE 'wrong' END AS status,
                 l.toxic = 1 OR (l.doc_id * 7 + run) % 11 = 0 AS rule_flagged, (l.doc_id + run) % 4 <> 0 AS shown_green
          FROM (SELECT *, EXPLODE[1, 2] AS run FROM {labels}) l JOIN {documents} d ON d.doc_id = l.doc_id) o""",
    # Expected and read values of one field and document, for the benchmark's tallies.
    "readings": """
        SELECT annotation_id, field_key, CASE WHEN seed % 12 = 1 THEN NULL ELSE value END AS expected,
               CASE WHEN seed % 13 = 5 THEN NULL WHEN seed % 10 = 3 THEN value || '1' ELSE value END AS got,
               seed % 4 <> 0 AS flagged,
               CASE WHEN annotation_id % 3 = 0 THEN 'producer-a' ELSE 'producer-b' END AS producer,
               CASE WHEN annotation_id % 2 = 0 THEN 'vision' ELSE 'text' END AS path
        FROM {field_cells} WHERE row_index IS NULL""",
    # Words of documents with a made-up but fixed layout: eight words a line of height 20, gaps that vary by position.
    "words": """
        SELECT doc_id, CAST(pos AS INT) AS pos, word, CAST(floor(pos / 8) AS INT) AS line,
               (pos % 8) * 100 + (pos * 7) % 13 AS x0, (pos % 8) * 100 + (pos * 7) % 13 + 60 + (pos * 11) % 50 AS x1,
               CAST(floor(pos / 8) AS INT) * 20 AS y0, CAST(floor(pos / 8) AS INT) * 20 + 20 AS y1
        FROM {doc_words}""",
}
#: Views whose text differs by engine.
SPARK_ONLY = {
    "doc_pages": "SELECT id AS document_id, explode(sequence(1, page_count)) AS page FROM {docs}",
    "doc_words": "SELECT doc_id, pos, word FROM (SELECT doc_id, posexplode(split(text, ' ')) AS (pos, word) FROM {documents}) w",
}
DUCK_ONLY = {
    "doc_pages": "SELECT id AS document_id, CAST(unnest(generate_series(1, page_count)) AS INT) AS page FROM {docs}",
    "doc_words": """
        SELECT doc_id, pos - 1 AS pos, word FROM (
          SELECT doc_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS pos FROM {documents}) w""",
}

_NAME = re.compile(r"\{(\w+)\}")
_EXPLODE = re.compile(r"EXPLODE\[([^\]]*)\]")


def _uses(text: str) -> list[str]:
    return list(dict.fromkeys(_NAME.findall(text)))


#: Views that cost a shuffle of the largest table: written once where a query needs them several times.
SHARED = ("inv_header",)


def shared_views(spark: SparkSession, sf_dir: str, uses: tuple[str, ...]) -> dict[str, DataFrame]:
    """The shared views that ``uses`` need more than once, as written tables."""
    texts = {**VIEWS, **SPARK_ONLY}

    def times(name: str, wanted: str) -> int:
        return 1 if name == wanted else sum(times(n, wanted) for n in _uses(texts[name])) if name in texts else 0

    return {n: materialize(view(spark, sf_dir, n), n) for n in SHARED if sum(times(u, n) for u in uses) > 1}


def view(spark: SparkSession, sf_dir: str, name: str, held: dict[str, DataFrame] | None = None) -> DataFrame:
    """A bridge view (or a plain table) as a DataFrame; views in ``held`` are taken from there."""
    if held and name in held:
        return held[name]
    if name in TABLES:
        return table(spark, sf_dir, name)
    text = {**VIEWS, **SPARK_ONLY}[name]
    frames = {n: view(spark, sf_dir, n, held) for n in _uses(text)}
    return spark.sql(_EXPLODE.sub(r"explode(array(\1))", text), **frames)


def duck_sql(query: str) -> str:
    """``query`` with the bridge views it names in front, for DuckDB."""
    texts = {**VIEWS, **DUCK_ONLY}
    order: list[str] = []

    def need(text: str) -> None:
        for name in _uses(text):
            if name in texts and name not in order:
                need(texts[name])
                order.append(name)

    need(query)
    plain = lambda text: _NAME.sub(r"\1", _EXPLODE.sub(r"unnest([\1])", text)).strip()
    body = plain(query)
    if not order:
        return body
    # Materialised, or each use of a view would expand it anew.
    head = ", ".join(f"{n} AS MATERIALIZED ({plain(texts[n])})" for n in order)
    return f"WITH {head}, {body[5:].lstrip()}" if body[:5].upper() == "WITH " else f"WITH {head} {body}"
