"""Scans, projections, filters, set operations, sorts and limits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.operators.ranking import global_rank
from ledgerlens.operators.tenancy import TenantScope
from ledgerlens.plans.bridge import AS_OF, STALLED_AFTER_S
from ledgerlens.plans.catalog import op



def effective() -> Column:
    """The value that counts: the reviewed one, else the extracted one."""
    return F.coalesce("value_final", "value_extracted")


PROCESSED = ("to_review", "reviewing", "confirmed", "approved", "exporting", "exported", "rejected")
#: Statuses that a user sees as finished, and those shown as failed.
CONFIRMED, FAILED_UI = ("confirmed", "approved", "exporting", "exported"), ("failed", "stalled", "rejected")
PRESERVED = ("SUSPICIOUS_DOCUMENT_CONTENT", "PIPELINE_FAILED")
DERIVED = ("computed", "ocr_rule")


def state(status: Column, created_at: Column, as_of: str = AS_OF, stalled_after: int = STALLED_AFTER_S) -> Column:
    """The annotation's status; without one stalled after a while, else processing."""
    limit = F.expr(f"{as_of} - INTERVAL {stalled_after} SECOND")
    return F.when(status.isNotNull(), status).when(created_at < limit, "stalled").otherwise("processing")


def category(st: Column, blocking: Column) -> Column:
    """What a document list shows: processing, failed, confirmed, blocked or review."""
    return (
        F.when(st.isin("processing", "importing"), "processing")
        .when(st.isin(*FAILED_UI), "failed")
        .when(st.isin(*CONFIRMED), "confirmed")
        .when(blocking > 0, "blocked")
        .otherwise("review")
    )


def latest_annotation(annotations):
    """The newest annotation of each document; ties go to the larger id."""
    rank = F.row_number().over(W.partitionBy("document_id").orderBy(F.desc("created_at"), F.desc("id")))
    return annotations.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


LATEST_SQL = """
latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, id DESC) AS rn FROM {annotations}) a WHERE rn = 1
), state AS (
  SELECT d.*, a.id AS annotation_id, a.model_version, a.created_at AS annotated_at,
         CASE WHEN a.id IS NOT NULL THEN a.status
              WHEN d.created_at < TIMESTAMP '1998-01-01 01:00:00' - INTERVAL 900 SECOND THEN 'stalled' ELSE 'processing' END AS st
  FROM {docs} d LEFT JOIN latest a ON a.document_id = d.id
)"""


def document_states(docs, annotations):
    last = latest_annotation(annotations).select(
        F.col("document_id").alias("id"), F.col("id").alias("annotation_id"), "status", "model_version", F.col("created_at").alias("annotated_at")
    )
    return docs.join(last, "id", "left").withColumn("st", state(F.col("status"), F.col("created_at")))


@op("src_table", "orders", oracle="SELECT o_orderkey, o_custkey, o_totalprice FROM {orders} WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def src_table(orders):
    return orders.where("o_orderstatus = 'F' AND o_totalprice > 100000").select("o_orderkey", "o_custkey", "o_totalprice")


@op(
    "src_delim",
    "documents",
    oracle="""SELECT doc_id, part FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS part FROM {documents}) p WHERE part <> ''""",
)
def src_delim(documents):
    parts = documents.select("doc_id", F.explode(F.split("text", "\n")).alias("part"))
    return parts.select("doc_id", F.trim("part").alias("part")).where("part <> ''")


@op("proj_effective", "fields", oracle="SELECT annotation_id, field_key, row_index, coalesce(value_final, value_extracted) AS value FROM {fields}")
def proj_effective(fields):
    return fields.select("annotation_id", "field_key", "row_index", effective().alias("value"))


@op(
    "flt_eq_null_safe", "fields", "corrections",
    oracle="""SELECT f.annotation_id, f.field_key, f.row_index, count(*) AS n FROM {fields} f JOIN {corrections} c
      ON c.annotation_id = f.annotation_id AND c.field_key = f.field_key AND c.row_index IS NOT DISTINCT FROM f.row_index GROUP BY ALL""",
)
def flt_eq_null_safe(fields, corrections):
    f, c = fields.alias("f"), corrections.alias("c")
    on = F.expr("c.annotation_id = f.annotation_id AND c.field_key = f.field_key AND c.row_index <=> f.row_index")
    return f.join(c, on).groupBy("f.annotation_id", "f.field_key", "f.row_index").agg(F.count(F.lit(1)).alias("n"))


@op(
    "flt_distinct_from", "fields",
    oracle="SELECT annotation_id, field_key, row_index, value_extracted, value_final FROM {fields} WHERE value_final IS DISTINCT FROM value_extracted",
)
def flt_distinct_from(fields):
    return fields.where(~F.col("value_final").eqNullSafe(F.col("value_extracted"))).select(
        "annotation_id", "field_key", "row_index", "value_extracted", "value_final"
    )


@op("flt_any", "findings", oracle="SELECT annotation_id, rule_code, passed FROM {findings} WHERE NOT (rule_code IN ('SUSPICIOUS_DOCUMENT_CONTENT', 'PIPELINE_FAILED'))")
def flt_any(findings):
    return findings.where(~F.col("rule_code").isin(*PRESERVED)).select("annotation_id", "rule_code", "passed")


@op(
    "flt_header_line", "fields",
    oracle="""SELECT CASE WHEN row_index IS NULL THEN 'header' ELSE 'line' END AS section, field_key, count(*) AS n,
      count(value_extracted) AS filled FROM {fields} GROUP BY ALL""",
)
def flt_header_line(fields):
    section = F.when(F.col("row_index").isNull(), "header").otherwise("line").alias("section")
    return fields.groupBy(section, "field_key").agg(F.count(F.lit(1)).alias("n"), F.count("value_extracted").alias("filled"))


@op("proj_state", "docs", "annotations", oracle="WITH " + LATEST_SQL + " SELECT id, annotation_id, st AS state FROM state")
def proj_state(docs, annotations):
    return document_states(docs, annotations).select("id", "annotation_id", F.col("st").alias("state"))


BLOCKING_SQL = "blocked AS (SELECT annotation_id, count(*) FILTER (WHERE severity = 'error' AND NOT passed) AS blocking FROM {findings} GROUP BY annotation_id)"
CATEGORY_SQL = """CASE WHEN st IN ('processing', 'importing') THEN 'processing' WHEN st IN ('failed', 'stalled', 'rejected') THEN 'failed'
  WHEN st IN ('confirmed', 'approved', 'exporting', 'exported') THEN 'confirmed' WHEN coalesce(blocking, 0) > 0 THEN 'blocked' ELSE 'review' END"""


def blocking_counts(findings):
    return findings.groupBy("annotation_id").agg(F.count_if((F.col("severity") == "error") & ~F.col("passed")).alias("blocking"))


def categorized(docs, annotations, findings):
    joined = document_states(docs, annotations).join(blocking_counts(findings), "annotation_id", "left")
    return joined.withColumn("category", category(F.col("st"), F.coalesce("blocking", F.lit(0))))


@op(
    "proj_category", "docs", "annotations", "findings",
    oracle="WITH " + LATEST_SQL + ", " + BLOCKING_SQL + f" SELECT s.id, {CATEGORY_SQL} AS category FROM state s LEFT JOIN blocked b ON b.annotation_id = s.annotation_id",
)
def proj_category(docs, annotations, findings):
    return categorized(docs, annotations, findings).select("id", "category")


@op(
    "flt_search", "docs", "fields",
    oracle="""SELECT d.id, d.filename FROM {docs} d LEFT JOIN (SELECT annotation_id,
        max(coalesce(value_final, value_extracted)) FILTER (WHERE field_key = 'seller_name') AS seller FROM {fields} WHERE row_index IS NULL GROUP BY annotation_id) f
      ON f.annotation_id = d.id WHERE contains(lower(coalesce(f.seller, '')), 'seller 1') OR contains(lower(coalesce(d.filename, '')), '#00000001')""",
)
def flt_search(docs, fields):
    seller = fields.where("row_index IS NULL").groupBy("annotation_id").agg(F.max(F.when(F.col("field_key") == "seller_name", effective())).alias("seller"))
    has = lambda c, q: F.lower(F.coalesce(F.col(c), F.lit(""))).contains(q)
    joined = docs.join(seller, docs["id"] == seller["annotation_id"], "left")
    return joined.where(has("seller", "seller 1") | has("filename", "#00000001")).select("id", "filename")


@op("flt_exportable", "annotations", oracle="SELECT id, status FROM {annotations} WHERE status IN ('confirmed', 'exported')")
def flt_exportable(annotations):
    return annotations.where(F.col("status").isin("confirmed", "exported")).select("id", "status")


@op(
    "flt_confirmable", "annotations", "findings",
    oracle="""SELECT a.id, a.status, a.status IN ('confirmed', 'exported') AS already FROM {annotations} a
      WHERE a.status IN ('confirmed', 'exported') OR (a.status IN ('to_review', 'reviewing') AND NOT EXISTS (
        SELECT 1 FROM {findings} v WHERE v.annotation_id = a.id AND v.severity = 'error' AND NOT v.passed))""",
)
def flt_confirmable(annotations, findings):
    open_errors = findings.where("severity = 'error' AND NOT passed").select(F.col("annotation_id").alias("id")).distinct()
    done = annotations.where(F.col("status").isin("confirmed", "exported"))
    ready = annotations.where(F.col("status").isin("to_review", "reviewing")).join(open_errors, "id", "left_anti")
    return done.unionByName(ready.select(done.columns)).select("id", "status", F.col("status").isin("confirmed", "exported").alias("already"))


@op(
    "proj_validation_state", "fields", "findings",
    oracle="""WITH k AS (SELECT annotation_id, list(DISTINCT field_key) FILTER (WHERE severity = 'error' AND NOT passed AND field_key IS NOT NULL) AS b,
        list(DISTINCT field_key) FILTER (WHERE severity = 'warning' AND NOT passed AND field_key IS NOT NULL) AS w FROM {findings} GROUP BY annotation_id)
      SELECT f.annotation_id, f.field_key, f.row_index,
        CASE WHEN list_contains(coalesce(k.b, []), f.field_key) THEN 'blocking' WHEN f.validation_state = 'blocking' THEN 'review_suggested'
             WHEN list_contains(coalesce(k.w, []), f.field_key) AND f.validation_state = 'auto_validated' THEN 'review_suggested' ELSE f.validation_state END AS state
      FROM {fields} f LEFT JOIN k ON k.annotation_id = f.annotation_id""",
)
def proj_validation_state(fields, findings):
    failed = findings.where("NOT passed AND field_key IS NOT NULL")
    keys = failed.groupBy("annotation_id").agg(
        F.collect_set(F.when(F.col("severity") == "error", F.col("field_key"))).alias("blocking"),
        F.collect_set(F.when(F.col("severity") == "warning", F.col("field_key"))).alias("warned"),
    )
    own = lambda c: F.coalesce(F.array_contains(c, F.col("field_key")), F.lit(False))
    was = F.col("validation_state")
    new = (
        F.when(own("blocking"), "blocking").when(was == "blocking", "review_suggested")
        .when(own("warned") & (was == "auto_validated"), "review_suggested").otherwise(was)
    )
    return fields.join(keys, "annotation_id", "left").select("annotation_id", "field_key", "row_index", new.alias("state"))


@op(
    "proj_automated", "annotations", "findings",
    oracle="WITH " + BLOCKING_SQL + """ SELECT a.id, a.automated AND coalesce(b.blocking, 0) = 0 AS after_refresh, false AS after_edit,
      a.id % 3 = 0 AND coalesce(b.blocking, 0) = 0 AS at_first FROM {annotations} a LEFT JOIN blocked b ON b.annotation_id = a.id""",
)
def proj_automated(annotations, findings):
    joined = annotations.join(blocking_counts(findings).withColumnRenamed("annotation_id", "id"), "id", "left")
    clear = F.coalesce("blocking", F.lit(0)) == 0
    return joined.select("id", (F.col("automated") & clear).alias("after_refresh"), F.lit(False).alias("after_edit"), ((F.col("id") % 3 == 0) & clear).alias("at_first"))


PROVENANCE = """CASE WHEN source = 'ubl_xml' AND shadow_value IS NOT NULL AND shadow_value <> coalesce(value_final, value_extracted) THEN 'mismatch'
  WHEN source = 'ubl_xml' THEN 'verified' WHEN source = 'qr' THEN 'qr' WHEN source = 'human' THEN 'human'
  WHEN coalesce(value_final, value_extracted) IS NULL THEN 'absent' WHEN source = 'computed' THEN 'derived' ELSE 'extracted' END"""


def provenance() -> Column:
    """mismatch, verified, qr, human, then absent, derived or extracted."""
    source = F.col("source")
    return (
        F.when((source == "ubl_xml") & F.coalesce(F.col("shadow_value") != effective(), F.lit(False)), "mismatch")
        .when(source == "ubl_xml", "verified").when(source == "qr", "qr").when(source == "human", "human")
        .when(effective().isNull(), "absent").when(source == "computed", "derived").otherwise("extracted")
    )


@op("proj_provenance", "fields", oracle=f"SELECT annotation_id, field_key, row_index, {PROVENANCE} AS kind FROM {{fields}}")
def proj_provenance(fields):
    return fields.select("annotation_id", "field_key", "row_index", provenance().alias("kind"))


CHECK_CODES = ("TRN_FORMAT", "QR_TOTAL_MATCH", "GRAND_TOTAL_MISMATCH", "REQUIRED_FIELD_MISSING")


def verdicts(annotations, findings):
    """Each annotation's first served finding (failed first) of each checked code."""
    first = findings.where(F.col("rule_code").isin(*CHECK_CODES)).groupBy("annotation_id", "rule_code").agg(F.min("passed").alias("passed"))
    codes = F.explode(F.array(*map(F.lit, CHECK_CODES))).alias("rule_code")
    every = annotations.select(F.col("id").alias("annotation_id"), codes)
    verdict = F.when(F.col("passed").isNull(), "unknown").when(F.col("passed"), "ok").otherwise("bad")
    return every.join(first, ["annotation_id", "rule_code"], "left").select("annotation_id", "rule_code", verdict.alias("verdict"))


VERDICT_SQL = """verdicts AS (SELECT a.id AS annotation_id, c.rule_code, CASE WHEN f.passed IS NULL THEN 'unknown' WHEN f.passed THEN 'ok' ELSE 'bad' END AS verdict
  FROM {annotations} a CROSS JOIN (VALUES ('TRN_FORMAT'), ('QR_TOTAL_MATCH'), ('GRAND_TOTAL_MISMATCH'), ('REQUIRED_FIELD_MISSING')) c(rule_code)
  LEFT JOIN (SELECT annotation_id, rule_code, bool_and(passed) AS passed FROM {findings} GROUP BY ALL) f ON f.annotation_id = a.id AND f.rule_code = c.rule_code)"""


@op("proj_verdict", "annotations", "findings", oracle="WITH " + VERDICT_SQL + " SELECT * FROM verdicts")
def proj_verdict(annotations, findings):
    return verdicts(annotations, findings)


@op(
    "proj_zatca_checks", "annotations", "findings",
    oracle="WITH " + VERDICT_SQL + """ SELECT annotation_id, max(verdict) FILTER (WHERE rule_code = 'TRN_FORMAT') AS trn,
      max(verdict) FILTER (WHERE rule_code = 'QR_TOTAL_MATCH') AS qr, max(verdict) FILTER (WHERE rule_code = 'GRAND_TOTAL_MISMATCH') AS total,
      max(verdict) FILTER (WHERE rule_code = 'REQUIRED_FIELD_MISSING') AS required, count(*) FILTER (WHERE verdict = 'ok') AS passed,
      count(*) FILTER (WHERE verdict = 'bad') AS failed FROM verdicts GROUP BY annotation_id""",
)
def proj_zatca_checks(annotations, findings):
    pick = lambda code: F.max(F.when(F.col("rule_code") == code, F.col("verdict")))
    names = ("trn", "qr", "total", "required")
    return verdicts(annotations, findings).groupBy("annotation_id").agg(
        *[pick(c).alias(n) for c, n in zip(CHECK_CODES, names, strict=True)],
        F.count_if(F.col("verdict") == "ok").alias("passed"),
        F.count_if(F.col("verdict") == "bad").alias("failed"),
    )


@op("flt_page_boxes", "fields", oracle="SELECT annotation_id, field_key, row_index FROM {fields} WHERE bbox_page = 2")
def flt_page_boxes(fields):
    return fields.where("bbox_page = 2").select("annotation_id", "field_key", "row_index")


@op(
    "flt_admission", "documents",
    oracle="""WITH a AS (SELECT source, doc_id, n_chars, CASE WHEN lang = 'es' THEN 'not_pdf' WHEN n_chars > 5000 THEN 'too_large' ELSE 'ok' END AS verdict FROM {documents}),
      r AS (SELECT *, row_number() OVER (PARTITION BY source, verdict ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY source, verdict) AS n FROM a)
      SELECT source, doc_id, CASE WHEN verdict = 'ok' AND rn > 20 THEN 'over_limit' ELSE verdict END AS verdict, verdict = 'ok' AND n > 20 AS truncated FROM r""",
)
def flt_admission(documents):
    """Per batch (source): type and size checks, then the first twenty that pass."""
    verdict = F.when(F.col("lang") == "es", "not_pdf").when(F.col("n_chars") > 5000, "too_large").otherwise("ok")
    w = W.partitionBy("source", "verdict")
    ranked = documents.select("source", "doc_id", verdict.alias("verdict")).withColumns(
        {"rn": F.row_number().over(w.orderBy("doc_id")), "n": F.count(F.lit(1)).over(w)}
    )
    ok = F.col("verdict") == "ok"
    return ranked.select("source", "doc_id", F.when(ok & (F.col("rn") > 20), "over_limit").otherwise(F.col("verdict")).alias("verdict"), (ok & (F.col("n") > 20)).alias("truncated"))


TIER = "CASE validation_state WHEN 'blocking' THEN 0 WHEN 'auto_validated' THEN 2 ELSE 1 END"


def tier() -> Column:
    s = F.col("validation_state")
    return F.when(s == "blocking", 0).when(s == "auto_validated", 2).otherwise(1)


@op("proj_tier", "fields", oracle="SELECT annotation_id, field_key, row_index, CASE validation_state WHEN 'blocking' THEN 'blocking' WHEN 'auto_validated' THEN 'validated' ELSE 'review' END AS tier FROM {fields}")
def proj_tier(fields):
    s = F.col("validation_state")
    return fields.select("annotation_id", "field_key", "row_index", F.when(s == "blocking", "blocking").when(s == "auto_validated", "validated").otherwise("review").alias("tier"))


@op("flt_blockers", "findings", oracle="SELECT annotation_id, rule_code, message_en FROM {findings} WHERE severity = 'error' AND NOT passed")
def flt_blockers(findings):
    return findings.where("severity = 'error' AND NOT passed").select("annotation_id", "rule_code", "message_en")


# Sorts and limits: the order is checked by the rank column that the result carries.
@op("so_newest", "docs", oracle="SELECT id, filename, rank FROM (SELECT id, filename, CAST(row_number() OVER (ORDER BY created_at DESC, id) AS INT) AS rank FROM {docs}) r WHERE rank <= 100")
def so_newest(docs):
    return ranked_top(docs, [F.desc("created_at"), F.asc("id")], 100).select("id", "filename", "rank")


def ranked_top(df, order: list[Column], n: int):
    """The first n rows by ``order`` with their rank; only n rows meet in the single ranking task."""
    top = df.orderBy(*order).limit(n)
    return top.withColumn("rank", F.row_number().over(W.orderBy(*order)))


@op("so_annotations", "annotations", oracle="SELECT id, status, rank FROM (SELECT id, status, CAST(row_number() OVER (ORDER BY created_at DESC, id DESC) AS INT) AS rank FROM {annotations}) r WHERE rank <= 100")
def so_annotations(annotations):
    return ranked_top(annotations, [F.desc("created_at"), F.desc("id")], 100).select("id", "status", "rank")


@op("so_fields", "fields", oracle="SELECT annotation_id, field_key, row_index, CAST(row_number() OVER (PARTITION BY annotation_id ORDER BY field_key, row_index NULLS FIRST) AS INT) AS rank FROM {fields}")
def so_fields(fields):
    w = W.partitionBy("annotation_id").orderBy("field_key", F.asc_nulls_first("row_index"))
    return fields.select("annotation_id", "field_key", "row_index", F.row_number().over(w).alias("rank"))


@op("so_findings", "findings", oracle="SELECT annotation_id, rule_code, passed, message_en, CAST(row_number() OVER (PARTITION BY annotation_id ORDER BY passed, rule_code, message_en, line_no, supp_no) AS INT) AS rank FROM {findings}")
def so_findings(findings):
    w = W.partitionBy("annotation_id").orderBy("passed", "rule_code", "message_en", "line_no", "supp_no")
    return findings.select("annotation_id", "rule_code", "passed", "message_en", F.row_number().over(w).alias("rank"))


@op("so_templates", "schemas", "queues", oracle="""SELECT e.id, q.name AS queue_name, e.version,
  CAST(row_number() OVER (ORDER BY q.name NULLS LAST, e.version DESC, e.id) AS INT) AS rank FROM {schemas} e LEFT JOIN {queues} q ON q.id = e.queue_id""")
def so_templates(schemas, queues):
    named = schemas.join(queues.select(F.col("id").alias("queue_id"), F.col("name").alias("queue_name")), "queue_id", "left")
    order = [F.asc_nulls_last("queue_name"), F.desc("version"), F.asc("id")]
    return global_rank(named.select("id", "queue_name", "version"), order).withColumn("rank", F.col("rank").cast("int"))


@op("so_schema_order", "fields", "specs", oracle="""SELECT f.annotation_id, f.field_key, CAST(row_number() OVER (PARTITION BY f.annotation_id ORDER BY coalesce(s.position, 9), f.field_key) AS INT) AS rank
  FROM {fields} f LEFT JOIN {specs} s ON s.field_key = f.field_key WHERE f.row_index IS NULL""")
def so_schema_order(fields, specs):
    joined = fields.where("row_index IS NULL").join(F.broadcast(specs.select("field_key", "position")), "field_key", "left")
    w = W.partitionBy("annotation_id").orderBy(F.coalesce("position", F.lit(9)), "field_key")
    return joined.select("annotation_id", "field_key", F.row_number().over(w).alias("rank"))


@op("so_tiers", "fields", "specs", oracle=f"""SELECT f.annotation_id, f.field_key, f.row_index, CAST(row_number() OVER (PARTITION BY f.annotation_id ORDER BY {TIER},
  CASE WHEN f.row_index IS NULL THEN 0 ELSE 1 END, coalesce(f.row_index, 0), coalesce(s.position, 9), f.field_key) AS INT) AS rank FROM {{fields}} f LEFT JOIN {{specs}} s ON s.field_key = f.field_key""")
def so_tiers(fields, specs):
    joined = fields.join(F.broadcast(specs.select("field_key", "position")), "field_key", "left")
    order = [tier(), F.when(F.col("row_index").isNull(), 0).otherwise(1), F.coalesce("row_index", F.lit(0)), F.coalesce("position", F.lit(9)), F.col("field_key")]
    return joined.select("annotation_id", "field_key", "row_index", F.row_number().over(W.partitionBy("annotation_id").orderBy(*order)).alias("rank"))


@op("so_batch_keys", "fields", "specs", oracle="""SELECT field_key, min(coalesce(position, 9)) AS position FROM (SELECT f.field_key, s.position FROM {fields} f LEFT JOIN {specs} s ON s.field_key = f.field_key
) k GROUP BY field_key""")
def so_batch_keys(fields, specs):
    joined = fields.join(F.broadcast(specs.select("field_key", "position")), "field_key", "left")
    return joined.groupBy("field_key").agg(F.min(F.coalesce("position", F.lit(9))).alias("position"))


@op("so_recent", "docs", oracle="SELECT id FROM {docs} ORDER BY created_at DESC, id LIMIT 8")
def so_recent(docs):
    return docs.orderBy(F.desc("created_at"), "id").limit(8).select("id")


@op("so_vision_cap", "docs", oracle="""SELECT id, page FROM (SELECT id, CAST(unnest(generate_series(1, page_count)) AS INT) AS page FROM {docs}) p WHERE page <= 2""")
def so_vision_cap(docs):
    """The first two pages of each document."""
    return docs.select("id", F.explode(F.sequence(F.lit(1), "page_count")).alias("page")).where("page <= 2")


# Set operations.
@op("st_union", "findings", oracle="""SELECT annotation_id, rule_code, 'rule' AS origin FROM {findings} WHERE rule_code <> 'PIPELINE_FAILED'
  UNION ALL SELECT annotation_id, rule_code, 'kept' FROM {findings} WHERE rule_code = 'PIPELINE_FAILED'
  UNION ALL SELECT DISTINCT annotation_id, 'PAGE_TEXT_EMPTY', 'page' FROM {findings} WHERE line_no = 7""")
def st_union(findings):
    rules = findings.where("rule_code <> 'PIPELINE_FAILED'").select("annotation_id", "rule_code", F.lit("rule").alias("origin"))
    kept = findings.where("rule_code = 'PIPELINE_FAILED'").select("annotation_id", "rule_code", F.lit("kept").alias("origin"))
    pages = findings.where("line_no = 7").select("annotation_id", F.lit("PAGE_TEXT_EMPTY").alias("rule_code"), F.lit("page").alias("origin")).distinct()
    return rules.unionByName(kept).unionByName(pages)


@op("st_except", "documents", "labels", oracle="SELECT doc_id FROM {documents} WHERE doc_id NOT IN (SELECT doc_id FROM {labels} WHERE quality = 0)")
def st_except(documents, labels):
    return documents.select("doc_id").join(labels.where("quality = 0").select("doc_id"), "doc_id", "left_anti")


HALVES_SQL = """(SELECT doc_id, w[1:ceil(len(w) / 2)::BIGINT] AS a, w[ceil(len(w) / 2)::BIGINT + 1:] AS b FROM (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {documents}) t) h"""


def halves(text: str) -> list[Column]:
    """The words of a whole text in two arrays; the first has one more if their number is odd."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    first = F.ceil(F.size(words) / 2).cast("int")
    return [F.slice(words, 1, first), F.slice(words, first + 1, F.size(words) - first)]


@op("st_intersect", "documents", oracle="SELECT doc_id FROM " + HALVES_SQL + " WHERE len(list_intersect(a, b)) > 0")
def st_intersect(documents):
    """Documents with a word in both halves of their text."""
    return documents.where(F.arrays_overlap(*halves("text"))).select("doc_id")


@op("st_subset", "documents", oracle="SELECT doc_id, len(b) > 0 AND (list_has_all(b, a) OR list_has_all(a, b)) AS nested FROM " + HALVES_SQL)
def st_subset(documents):
    """Whether the words of one half of a text all appear in the other; an empty half is in none."""
    a, b = halves("text")
    nested = (F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0)
    return documents.select("doc_id", (nested & (F.size(b) > 0)).alias("nested"))


@op("st_dedupe", "documents", oracle="""SELECT doc_id, word, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS INT) AS nth FROM (
  SELECT doc_id, word, min(pos) AS pos FROM {doc_words} WHERE doc_id % 10 = 0 GROUP BY doc_id, word) w""".replace("WHERE doc_id % 10 = 0 ", ""))
def st_dedupe(documents):
    """Distinct words in the order first seen."""
    words = documents.select("doc_id", F.posexplode(F.array_distinct(F.split("text", " "))).alias("at", "word"))
    return words.select("doc_id", "word", (F.col("at") + 1).cast("int").alias("nth"))


@op("st_flag_union", "findings", oracle="""SELECT annotation_id, len(list_distinct(list_concat(b, w))) AS flagged, len(list_filter(g, lambda x: NOT list_contains(b, x) AND NOT list_contains(w, x))) AS green FROM (
  SELECT annotation_id, coalesce(list(DISTINCT field_key) FILTER (WHERE severity = 'error' AND NOT passed AND field_key IS NOT NULL), []) AS b,
    coalesce(list(DISTINCT field_key) FILTER (WHERE severity = 'warning' AND NOT passed AND field_key IS NOT NULL), []) AS w,
    coalesce(list(DISTINCT field_key) FILTER (WHERE passed AND field_key IS NOT NULL), []) AS g FROM {findings} GROUP BY annotation_id) k""")
def st_flag_union(findings):
    keys = lambda cond: F.collect_set(F.when(F.expr(cond), F.col("field_key")))
    sets = findings.groupBy("annotation_id").agg(
        keys("severity = 'error' AND NOT passed").alias("b"), keys("severity = 'warning' AND NOT passed").alias("w"), keys("passed").alias("g")
    )
    flagged = F.array_union("b", "w")
    return sets.select("annotation_id", F.size(flagged).cast("long").alias("flagged"), F.size(F.array_except("g", flagged)).cast("long").alias("green"))


@op("st_missing_offenders", "annotations", oracle="""WITH asked AS (SELECT DISTINCT CAST(id * 7 AS BIGINT) AS id FROM {annotations}),
  j AS (SELECT q.id, a.status FROM asked q LEFT JOIN {annotations} a ON a.id = q.id)
  SELECT id, CASE WHEN status IS NULL THEN 'missing' WHEN status NOT IN ('confirmed', 'exported') THEN 'not_confirmed' ELSE 'ok' END AS verdict,
    (SELECT count(*) FROM j WHERE status IS NULL OR status NOT IN ('confirmed', 'exported')) = 0 AS batch_ok FROM j""")
def st_missing_offenders(annotations):
    """All or nothing: every offender is named, and the batch is fine only without any."""
    asked = annotations.select((F.col("id") * 7).alias("id")).distinct()
    status = F.col("status")
    verdict = F.when(status.isNull(), "missing").when(~status.isin("confirmed", "exported"), "not_confirmed").otherwise("ok")
    judged = asked.join(annotations.select("id", "status"), "id", "left").select("id", verdict.alias("verdict"))
    total = judged.agg((F.count_if(F.col("verdict") != "ok") == 0).alias("batch_ok"))
    return judged.join(F.broadcast(total))


@op("tenant_scope", "docs", oracle="SELECT id, filename FROM {docs} WHERE org_id = 'BUILDING'")
def tenant_scope(docs):
    """One tenant's documents through its scoped view."""
    return TenantScope({"docs": docs}.__getitem__, "BUILDING").table("docs").select("id", "filename")
