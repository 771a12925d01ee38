"""Joins: inner, left, latest-of-group, existence, null-safe, defaulting and containment."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.functions import scalars as S
from ledgerlens.plans.catalog import op
from ledgerlens.plans.projections import effective, LATEST_SQL, document_states, latest_annotation

REVIEWED = ("confirmed", "approved", "exporting", "exported")


@op("jn_inner", "annotations", "docs", oracle="SELECT a.id, a.document_id, a.status, d.has_embedded_ubl FROM {annotations} a JOIN {docs} d ON d.id = a.document_id")
def jn_inner(annotations, docs):
    return annotations.join(docs.select(F.col("id").alias("document_id"), "has_embedded_ubl"), "document_id").select("id", "document_id", "status", "has_embedded_ubl")


@op("jn_inner_schema", "annotations", "schemas", oracle="SELECT a.id, e.name AS schema_name, e.version FROM {annotations} a JOIN {schemas} e ON e.id = a.schema_id")
def jn_inner_schema(annotations, schemas):
    named = schemas.select(F.col("id").alias("schema_id"), F.col("name").alias("schema_name"), "version")
    return annotations.join(named, "schema_id").select("id", "schema_name", "version")


@op("jn_gt_docs", "readings", "inv_header", "docs", oracle="""SELECT r.annotation_id, d.filename, r.field_key, r.expected FROM {readings} r JOIN {inv_header} h ON h.annotation_id = r.annotation_id
  JOIN {docs} d ON d.id = h.document_id WHERE r.expected IS NOT NULL""")
def jn_gt_docs(readings, inv_header, docs):
    where = inv_header.select("annotation_id", "document_id").join(docs.select(F.col("id").alias("document_id"), "filename"), "document_id")
    return readings.where("expected IS NOT NULL").join(where, "annotation_id").select("annotation_id", "filename", "field_key", "expected")


@op("jn_reviewed", "fields", "annotations", oracle="""SELECT f.annotation_id, f.field_key, f.row_index FROM {fields} f JOIN {annotations} a ON a.id = f.annotation_id
  WHERE a.status IN ('confirmed', 'approved', 'exporting', 'exported')""")
def jn_reviewed(fields, annotations):
    reviewed = annotations.where(F.col("status").isin(*REVIEWED)).select(F.col("id").alias("annotation_id"))
    return fields.join(reviewed, "annotation_id", "left_semi").select("annotation_id", "field_key", "row_index")


@op("jn_left_queue", "schemas", "queues", oracle="SELECT e.id, e.queue_id, q.name AS queue_name, e.version FROM {schemas} e LEFT JOIN {queues} q ON q.id = e.queue_id")
def jn_left_queue(schemas, queues):
    return schemas.join(queues.select(F.col("id").alias("queue_id"), F.col("name").alias("queue_name")), "queue_id", "left").select("id", "queue_id", "queue_name", "version")


@op("jn_lateral_top1", "docs", "annotations", oracle="WITH " + LATEST_SQL + " SELECT id, annotation_id, annotated_at FROM state")
def jn_lateral_top1(docs, annotations):
    return document_states(docs, annotations).select("id", "annotation_id", "annotated_at")


@op("jn_dup_lookup", "docs", "annotations", oracle="WITH " + LATEST_SQL + """, h AS (SELECT id, sha256(org_id || '/' || queue_id) AS digest FROM {docs}), f AS (SELECT digest, min(id) AS document_id FROM h GROUP BY digest)
  SELECT h.id, f.document_id, s.annotation_id, s.st AS state FROM h JOIN f ON f.digest = h.digest JOIN state s ON s.id = f.document_id""")
def jn_dup_lookup(docs, annotations):
    """The document already stored for an upload's bytes (here its tenant and queue), with its latest annotation and state."""
    hashed = docs.select("id", F.sha2(F.concat_ws("/", "org_id", F.col("queue_id").cast("string")), 256).alias("digest"))
    stored = hashed.groupBy("digest").agg(F.min("id").alias("document_id"))
    states = document_states(docs, annotations).select(F.col("id").alias("document_id"), "annotation_id", F.col("st").alias("state"))
    # The few stored documents get their state first, so uploads of one content meet one row.
    return hashed.join(stored.join(states, "document_id"), "digest").select("id", "document_id", "annotation_id", "state")


HEADER = ("invoice_number", "seller_name", "total_amount", "currency")


def header_pivot(fields, keys=HEADER):
    """One row per annotation: the greatest effective value of each header key."""
    own = lambda k: F.max(F.when(F.col("field_key") == k, effective())).alias(k)
    return fields.where("row_index IS NULL").groupBy("annotation_id").agg(*map(own, keys))


def finding_totals(findings):
    failed = F.when(F.col("rule_code") == "PIPELINE_FAILED", F.col("message_en"))
    return findings.groupBy("annotation_id").agg(F.count_if((F.col("severity") == "error") & ~F.col("passed")).alias("blocking"), F.max(failed).alias("error_en"))


PIVOT_SQL = """pivoted AS (SELECT annotation_id, max(coalesce(value_final, value_extracted)) FILTER (WHERE field_key = 'invoice_number') AS invoice_number,
    max(coalesce(value_final, value_extracted)) FILTER (WHERE field_key = 'seller_name') AS seller_name,
    max(coalesce(value_final, value_extracted)) FILTER (WHERE field_key = 'total_amount') AS total_amount,
    max(coalesce(value_final, value_extracted)) FILTER (WHERE field_key = 'currency') AS currency FROM {fields} WHERE row_index IS NULL GROUP BY annotation_id)"""
TOTALS_SQL = """totals AS (SELECT annotation_id, count(*) FILTER (WHERE severity = 'error' AND NOT passed) AS blocking,
    max(message_en) FILTER (WHERE rule_code = 'PIPELINE_FAILED') AS error_en FROM {findings} GROUP BY annotation_id)"""


@op("jn_lateral_agg", "docs", "annotations", "fields", "findings", oracle="WITH " + LATEST_SQL + ", " + PIVOT_SQL + ", " + TOTALS_SQL + """
  SELECT s.id AS document_id, s.annotation_id, s.st AS state, p.invoice_number, p.seller_name, p.total_amount, p.currency, coalesce(t.blocking, 0) AS blocking_count, t.error_en
  FROM state s LEFT JOIN pivoted p ON p.annotation_id = s.annotation_id LEFT JOIN totals t ON t.annotation_id = s.annotation_id""")
def jn_lateral_agg(docs, annotations, fields, findings):
    """The document list: state, header values and finding totals; both aggregates group before they join."""
    states = document_states(docs, annotations).select(F.col("id").alias("document_id"), "annotation_id", F.col("st").alias("state"))
    joined = states.join(header_pivot(fields), "annotation_id", "left").join(finding_totals(findings), "annotation_id", "left")
    return joined.select("document_id", "annotation_id", "state", *HEADER, F.coalesce("blocking", F.lit(0)).alias("blocking_count"), "error_en")


@op("jn_scalar_count", "annotations", "findings", oracle="""SELECT a.id, (SELECT count(*) FROM {findings} v WHERE v.annotation_id = a.id AND v.severity = 'error' AND NOT v.passed) AS blocking FROM {annotations} a""")
def jn_scalar_count(annotations, findings):
    counts = finding_totals(findings).select(F.col("annotation_id").alias("id"), "blocking")
    return annotations.join(counts, "id", "left").select("id", F.coalesce("blocking", F.lit(0)).alias("blocking"))


def corrected_fields(fields, corrections):
    """Fields with whether they had a value and whether a reviewer changed or deleted them."""
    deleted = corrections.where("action = 'delete'").select("annotation_id", "field_key", "row_index").distinct().withColumn("deleted", F.lit(True)).alias("d")
    f = fields.alias("f")
    on = F.expr("d.annotation_id = f.annotation_id AND d.field_key = f.field_key AND d.row_index <=> f.row_index")
    changed = ~effective().eqNullSafe(F.col("value_extracted"))
    return f.join(deleted, on, "left").select(
        "f.annotation_id", "f.field_key", "f.row_index", F.col("value_extracted").isNotNull().alias("had_value"), (changed | F.coalesce("deleted", F.lit(False))).alias("corrected")
    )


CORRECTED_SQL = """corrected AS (SELECT f.annotation_id, f.field_key, f.row_index, f.value_extracted IS NOT NULL AS had_value,
    (coalesce(f.value_final, f.value_extracted) IS DISTINCT FROM f.value_extracted OR EXISTS (SELECT 1 FROM {corrections} c WHERE c.annotation_id = f.annotation_id
      AND c.field_key = f.field_key AND c.row_index IS NOT DISTINCT FROM f.row_index AND c.action = 'delete')) AS corrected FROM {fields} f)"""


@op("jn_exists_or", "fields", "corrections", oracle="WITH " + CORRECTED_SQL + " SELECT * FROM corrected")
def jn_exists_or(fields, corrections):
    return corrected_fields(fields, corrections)


@op("jn_not_exists", "annotations", "findings", oracle="SELECT a.id FROM {annotations} a WHERE NOT EXISTS (SELECT 1 FROM {findings} f WHERE f.annotation_id = a.id)")
def jn_not_exists(annotations, findings):
    return annotations.join(findings.select(F.col("annotation_id").alias("id")), "id", "left_anti").select("id")


def last_reviewers(corrections):
    """The user of each field's latest correction (null where it has none)."""
    w = W.partitionBy("annotation_id", "field_key", "row_index").orderBy(F.desc("created_at"), F.desc("id"))
    return corrections.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("annotation_id", "field_key", "row_index", "user_id")


REVIEWER_SQL = """reviewers AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY annotation_id, field_key, row_index ORDER BY created_at DESC, id DESC) AS n FROM {corrections}) c WHERE n = 1)"""


@op("jn_map_default", "fields", "corrections", "annotations", oracle="WITH " + REVIEWER_SQL + """ SELECT f.annotation_id, f.field_key, f.row_index,
    CASE WHEN r.n IS NOT NULL THEN r.user_id ELSE a.confirmed_by END AS reviewed_by FROM {fields} f JOIN {annotations} a ON a.id = f.annotation_id
    LEFT JOIN reviewers r ON r.annotation_id = f.annotation_id AND r.field_key = f.field_key AND r.row_index IS NOT DISTINCT FROM f.row_index""")
def jn_map_default(fields, corrections, annotations):
    """The default holds only where no correction exists, not where its user is null."""
    r = last_reviewers(corrections).withColumn("known", F.lit(True)).alias("r")
    a = annotations.select(F.col("id").alias("annotation_id"), "confirmed_by")
    f = fields.join(a, "annotation_id").alias("f")
    on = F.expr("r.annotation_id = f.annotation_id AND r.field_key = f.field_key AND r.row_index <=> f.row_index")
    return f.join(r, on, "left").select(
        "f.annotation_id", "f.field_key", "f.row_index", F.when(F.col("known"), F.col("r.user_id")).otherwise(F.col("f.confirmed_by")).alias("reviewed_by")
    )


@op("jn_schema_specs", "fields", "specs", oracle="""SELECT f.annotation_id, f.field_key, f.row_index, coalesce(s.label_en, '') AS label_en, coalesce(s.type, 'string') AS type,
  coalesce(s.position, 9) AS position FROM {fields} f LEFT JOIN {specs} s ON s.field_key = f.field_key""")
def jn_schema_specs(fields, specs):
    """Specs are the nine rows of a schema, so they are broadcast."""
    joined = fields.join(F.broadcast(specs), "field_key", "left")
    return joined.select(
        "annotation_id", "field_key", "row_index", F.coalesce("label_en", F.lit("")).alias("label_en"), F.coalesce("type", F.lit("string")).alias("type"), F.coalesce("position", F.lit(9)).alias("position")
    )


@op("jn_upload_live", "docs", "annotations", oracle="WITH " + LATEST_SQL + """ SELECT id, CASE WHEN annotated_at >= TIMESTAMP '1997-01-01 00:00:00' THEN st ELSE 'uploading' END AS shown FROM state""")
def jn_upload_live(docs, annotations):
    """Upload rows with their live state; snapshots from before the upload count for nothing."""
    last = latest_annotation(annotations).select(F.col("document_id").alias("id"), "status", F.col("created_at").alias("seen_at"))
    fresh = last.where("seen_at >= TIMESTAMP '1997-01-01 00:00:00'")
    return docs.join(fresh, "id", "left").select("id", F.coalesce("status", F.lit("uploading")).alias("shown"))


@op("jn_pred_truth", "readings", oracle="""SELECT t.annotation_id, t.field_key, t.expected, p.got, p.got IS NULL AS missing FROM {readings} t
  LEFT JOIN (SELECT annotation_id, field_key, got FROM {readings} WHERE got IS NOT NULL) p ON p.annotation_id = t.annotation_id AND p.field_key = t.field_key WHERE t.expected IS NOT NULL""")
def jn_pred_truth(readings):
    truth = readings.where("expected IS NOT NULL").select("annotation_id", "field_key", "expected")
    predictions = readings.where("got IS NOT NULL").select("annotation_id", "field_key", "got")
    return truth.join(predictions, ["annotation_id", "field_key"], "left").withColumn("missing", F.col("got").isNull())


@op("jn_run_compare", "outcomes", oracle="""SELECT b.field, b.correct AS before_correct, b.n AS before_n, coalesce(a.correct, 0) AS after_correct, coalesce(a.n, 0) AS after_n
  FROM (SELECT field, count(*) FILTER (WHERE status = 'correct') AS correct, count(*) AS n FROM {outcomes} WHERE run = 1 GROUP BY field) b
  LEFT JOIN (SELECT field, count(*) FILTER (WHERE status = 'correct') AS correct, count(*) AS n FROM {outcomes} WHERE run = 2 AND field <> 'es' GROUP BY field) a ON a.field = b.field""")
def jn_run_compare(outcomes):
    """The fields of the run before drive; one that the run after lacks counts as zeros."""
    def tally(run, cond="true"):
        return outcomes.where(f"run = {run} AND {cond}").groupBy("field").agg(F.count_if(F.col("status") == "correct").alias("correct"), F.count(F.lit(1)).alias("n"))

    before = tally(1).select("field", F.col("correct").alias("before_correct"), F.col("n").alias("before_n"))
    after = tally(2, "field <> 'es'").select("field", F.col("correct").alias("after_correct"), F.col("n").alias("after_n"))
    return before.join(after, "field", "left").fillna(0, ["after_correct", "after_n"])


@op("jn_theta_labels", "documents", oracle="""SELECT d.doc_id, l.label FROM {documents} d JOIN (VALUES ('Copyright'), ('License'), ('@example'), ('token')) l(label)
  ON contains(replace(replace(lower(d.text), ' ', ''), chr(10), ''), lower(l.label))""")
def jn_theta_labels(documents):
    """Labels that a page's text contains, by the label test itself; the label list is a constant."""
    labels = F.filter(F.transform(F.array(*map(F.lit, ("Copyright", "License", "@example", "token"))), lambda x: S.label_present(F.array(x), F.col("text"))), lambda x: x.isNotNull())
    return documents.select("doc_id", F.explode(labels).alias("label"))


@op("jn_qr_overlay", "fields", "inv_header", oracle="""WITH q AS (SELECT annotation_id, 'total_amount' AS field_key, qr_total AS qr_value FROM {inv_header} UNION ALL SELECT annotation_id, 'vat_amount', qr_vat FROM {inv_header})
  SELECT f.annotation_id, f.field_key, CASE WHEN q.qr_value IS NOT NULL AND f.source <> 'ubl_xml' THEN q.qr_value ELSE f.value_extracted END AS value,
    CASE WHEN q.qr_value IS NOT NULL AND f.source <> 'ubl_xml' THEN 'qr' ELSE f.source END AS source,
    CASE WHEN q.qr_value IS NOT NULL AND f.source = 'vlm' THEN f.value_extracted ELSE f.shadow_value END AS shadow_value
  FROM {fields} f LEFT JOIN q ON q.annotation_id = f.annotation_id AND q.field_key = f.field_key WHERE f.row_index IS NULL""")
def jn_qr_overlay(fields, inv_header):
    """QR values replace what was read, unless the signed XML said it; a model's reading is kept beside."""
    qr = inv_header.select("annotation_id", F.expr("stack(2, 'total_amount', qr_total, 'vat_amount', qr_vat) AS (field_key, qr_value)")).where("qr_value IS NOT NULL")
    joined = fields.where("row_index IS NULL").join(qr, ["annotation_id", "field_key"], "left")
    wins = F.col("qr_value").isNotNull() & (F.col("source") != "ubl_xml")
    return joined.select(
        "annotation_id", "field_key", F.when(wins, F.col("qr_value")).otherwise(F.col("value_extracted")).alias("value"),
        F.when(wins, "qr").otherwise(F.col("source")).alias("source"),
        F.when(wins & (F.col("source") == "vlm"), F.col("value_extracted")).otherwise(F.col("shadow_value")).alias("shadow_value"),
    )


# Exports: the flattened long form, the wide form, and the audit rows.
LONG_SQL = "WITH " + REVIEWER_SQL + """
  SELECT f.annotation_id, CASE WHEN f.row_index IS NULL THEN 'invoice' ELSE 'line_item' END AS section, f.row_index, f.field_key AS key, coalesce(s.label_en, '') AS label_en,
    coalesce(s.label_ar, '') AS label_ar, coalesce(s.type, 'string') AS type, coalesce(f.value_final, f.value_extracted) AS value, f.source, CAST(f.confidence AS VARCHAR) AS confidence,
    f.bbox_page, CAST(CASE WHEN r.n IS NOT NULL THEN r.user_id ELSE a.confirmed_by END AS VARCHAR) AS reviewed_by, f.value_extracted AS original_value,
    CAST(row_number() OVER (PARTITION BY f.annotation_id ORDER BY CASE WHEN f.row_index IS NULL THEN 0 ELSE 1 END, f.row_index, coalesce(s.position, 9), f.field_key) AS INT) AS position
  FROM {fields} f JOIN {annotations} a ON a.id = f.annotation_id LEFT JOIN {specs} s ON s.field_key = f.field_key
  LEFT JOIN reviewers r ON r.annotation_id = f.annotation_id AND r.field_key = f.field_key AND r.row_index IS NOT DISTINCT FROM f.row_index
  WHERE a.status IN ('confirmed', 'exported')"""


@op("op_export_long", "fields", "annotations", "specs", "corrections", oracle=LONG_SQL)
def op_export_long(fields, annotations, specs, corrections):
    return export_rows(fields, annotations, specs, corrections)


def export_rows(fields, annotations, specs, corrections):
    """One row per field of the exportable annotations: header first, then lines, in schema order."""
    ready = annotations.where(F.col("status").isin("confirmed", "exported")).select(F.col("id").alias("annotation_id"), "confirmed_by")
    r = last_reviewers(corrections).withColumn("known", F.lit(True)).alias("r")
    f = fields.join(ready, "annotation_id").join(F.broadcast(specs), "field_key", "left").alias("f")
    joined = f.join(r, F.expr("r.annotation_id = f.annotation_id AND r.field_key = f.field_key AND r.row_index <=> f.row_index"), "left")
    header = F.col("f.row_index").isNull()
    order = W.partitionBy("f.annotation_id").orderBy(F.when(header, 0).otherwise(1), "f.row_index", F.coalesce("position", F.lit(9)), "f.field_key")
    return joined.select(
        "f.annotation_id", F.when(header, "invoice").otherwise("line_item").alias("section"), "f.row_index", F.col("f.field_key").alias("key"),
        F.coalesce("label_en", F.lit("")).alias("label_en"), F.coalesce("label_ar", F.lit("")).alias("label_ar"), F.coalesce("type", F.lit("string")).alias("type"),
        effective().alias("value"), "source", F.col("confidence").cast("string").alias("confidence"), "bbox_page",
        F.when(F.col("known"), F.col("r.user_id")).otherwise(F.col("confirmed_by")).cast("string").alias("reviewed_by"),
        F.col("value_extracted").alias("original_value"), F.row_number().over(order).alias("position"),
    )


WIDE = ("invoice_number", "issue_date", "seller_name", "subtotal", "vat_amount", "total_amount")


@op("op_export_wide", "fields", "annotations", oracle="SELECT f.annotation_id, " + ", ".join(f"max(coalesce(value_final, value_extracted)) FILTER (WHERE field_key = '{k}') AS {k}" for k in WIDE)
    + " FROM {fields} f JOIN {annotations} a ON a.id = f.annotation_id WHERE a.status IN ('confirmed', 'exported') AND f.row_index IS NULL GROUP BY f.annotation_id")
def op_export_wide(fields, annotations):
    ready = annotations.where(F.col("status").isin("confirmed", "exported")).select(F.col("id").alias("annotation_id"))
    return header_pivot(fields.join(ready, "annotation_id", "left_semi"), WIDE)


@op("op_export_audit", "fields", "annotations", oracle="""SELECT a.id AS annotation_id, 'exported' AS status, count(*) FILTER (WHERE f.row_index IS NULL) AS fields, count(DISTINCT f.row_index) AS line_items
  FROM {annotations} a JOIN {fields} f ON f.annotation_id = a.id WHERE a.status IN ('confirmed', 'exported') GROUP BY a.id""")
def op_export_audit(fields, annotations):
    ready = annotations.where(F.col("status").isin("confirmed", "exported")).select(F.col("id").alias("annotation_id"))
    counted = fields.join(ready, "annotation_id", "left_semi").groupBy("annotation_id")
    return counted.agg(F.count_if(F.col("row_index").isNull()).alias("fields"), F.countDistinct("row_index").alias("line_items")).select("annotation_id", F.lit("exported").alias("status"), "fields", "line_items")


@op("sc_resolve_mode", "documents", oracle="""SELECT source, lang, CASE WHEN lang = 'en' THEN 'text' WHEN lang = 'de' THEN 'vision' WHEN count(*) FILTER (WHERE bad) > 0 THEN 'vision' ELSE 'text' END AS path,
  CASE WHEN lang = 'en' THEN 0 WHEN lang = 'de' THEN count(*) ELSE count(*) FILTER (WHERE bad) END AS vision_pages FROM (SELECT source, lang, n_chars < 400 AS bad FROM {documents}) p GROUP BY source, lang""")
def sc_resolve_mode(documents):
    """Mode by language (en: text, de: vision, others: auto by the pages' own state)."""
    bad, mode = F.col("n_chars") < 400, F.col("lang")
    per = documents.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("pages"), F.count_if(bad).alias("bad"))
    pages = F.when(mode == "en", F.lit(0)).when(mode == "de", F.col("pages")).otherwise(F.col("bad"))
    return per.select("source", "lang", F.when(mode == "en", "text").when((mode == "de") | (F.col("bad") > 0), "vision").otherwise("text").alias("path"), pages.cast("long").alias("vision_pages"))


