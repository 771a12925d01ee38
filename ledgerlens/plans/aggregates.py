"""Aggregations: pivots, conditional counts, rates, grouping sets and per-group texts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.functions import scalars as S
from ledgerlens.plans.catalog import op
from ledgerlens.plans.evaluation import CAUSES_SQL, error_causes
from ledgerlens.plans.projections import CATEGORY_SQL, BLOCKING_SQL, effective, LATEST_SQL, PROCESSED, PROVENANCE, blocking_counts, categorized, document_states, provenance
from ledgerlens.plans.relations import CORRECTED_SQL, PIVOT_SQL, REVIEWED, TOTALS_SQL, corrected_fields, finding_totals, header_pivot

#: The dashboard's counts: which states each counts (all: None), and which of their documents.
WAITING = ("to_review", "reviewing")
COUNTS = {
    "documents_total": (None, "every"), "processed": (PROCESSED, "every"), "in_progress": (("processing",), "every"), "awaiting_review": (WAITING, "every"),
    "blocked": (WAITING, "blocked"), "confirmed": (REVIEWED, "every"), "failed": (("failed", "stalled"), "every"), "from_signed_xml": (PROCESSED, "signed"),
}


def _counted(column):
    states, measure = COUNTS[column]
    names = ", ".join(f"('{s}')" for s in states or ())
    where = f" WHERE st IN (SELECT * FROM (VALUES {names}) AS v(s))" if states else ""
    return f"(SELECT coalesce(sum({measure}), 0)::BIGINT FROM by_state{where}) AS {column}"


STATS_SQL = "WITH " + LATEST_SQL + ", " + BLOCKING_SQL + """, by_state AS (SELECT st, count(*) AS every, count(b.annotation_id) FILTER (WHERE b.blocking > 0) AS blocked,
  sum(CAST(has_embedded_ubl AND model_version IS NULL AS INT)) AS signed FROM state s LEFT JOIN blocked b ON b.annotation_id = s.annotation_id GROUP BY st) SELECT """ + ", ".join(map(_counted, COUNTS))


def document_stats(docs, annotations, findings):
    """The eight dashboard counts over the documents' states, in one pass."""
    rows = document_states(docs, annotations).join(blocking_counts(findings), "annotation_id", "left")
    measures = {"every": F.lit(True), "blocked": F.coalesce(F.col("blocking") > 0, F.lit(False)), "signed": F.col("has_embedded_ubl") & F.col("model_version").isNull()}
    of = lambda states: F.col("st").isin(*states) if states else F.lit(True)
    return rows.agg(*[F.count_if(of(states) & measures[measure]).alias(name) for name, (states, measure) in COUNTS.items()])


@op("ag_pivot", "fields", oracle="WITH " + PIVOT_SQL + " SELECT * FROM pivoted")
def ag_pivot(fields):
    return header_pivot(fields)


@op("ag_filtered_counts", "docs", "annotations", "findings", oracle=STATS_SQL)
def ag_filtered_counts(docs, annotations, findings):
    return document_stats(docs, annotations, findings)


@op("ag_findings", "findings", oracle="WITH " + TOTALS_SQL + " SELECT * FROM totals")
def ag_findings(findings):
    return finding_totals(findings)


ACCURACY_SQL = "WITH " + CORRECTED_SQL + """, per AS (SELECT c.* FROM corrected c JOIN {annotations} a ON a.id = c.annotation_id WHERE a.status IN ('confirmed','approved','exporting','exported')),
  t AS (SELECT count(DISTINCT annotation_id) AS annotations, count(*) FILTER (WHERE had_value OR corrected) AS fields_total, count(*) FILTER (WHERE corrected) AS fields_corrected FROM per)"""


def accuracy(fields, corrections, annotations):
    """Reviewed annotations, fields that claim something, corrected ones; no row without any field."""
    reviewed = annotations.where(F.col("status").isin(*REVIEWED)).select(F.col("id").alias("annotation_id"))
    per = corrected_fields(fields, corrections).join(reviewed, "annotation_id", "left_semi")
    totals = per.agg(
        F.countDistinct("annotation_id").alias("annotations"), F.count_if(F.col("had_value") | F.col("corrected")).alias("fields_total"), F.count_if(F.col("corrected")).alias("fields_corrected")
    )
    return totals.where("fields_total > 0")


@op("ag_accuracy", "fields", "corrections", "annotations", oracle=ACCURACY_SQL + " SELECT * FROM t WHERE fields_total > 0")
def ag_accuracy(fields, corrections, annotations):
    return accuracy(fields, corrections, annotations)


@op("ag_accuracy_pct", "fields", "corrections", "annotations", oracle=ACCURACY_SQL + " SELECT round(100.0 * (fields_total - fields_corrected) / CAST(fields_total AS DOUBLE), 1) AS accuracy_pct FROM t WHERE fields_total > 0")
def ag_accuracy_pct(fields, corrections, annotations):
    total, changed = F.col("fields_total"), F.col("fields_corrected")
    return accuracy(fields, corrections, annotations).select(F.round(F.lit(100.0) * (total - changed) / total, 1).alias("accuracy_pct"))


@op("ag_counts_ui", "docs", "annotations", "findings", oracle="WITH " + LATEST_SQL + ", " + BLOCKING_SQL + f", c AS (SELECT {CATEGORY_SQL} AS category FROM state s LEFT JOIN blocked b ON b.annotation_id = s.annotation_id)"
    + " SELECT category, count(*) AS n FROM c GROUP BY category UNION ALL SELECT 'all', count(*) FROM c")
def ag_counts_ui(docs, annotations, findings):
    rows = categorized(docs, annotations, findings).rollup("category").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    return rows.select(F.when(F.col("g") == 1, "all").otherwise(F.col("category")).alias("category"), "n")


@op("ag_sources", "fields", oracle="""SELECT d.reader, count(f.reader) AS n FROM (VALUES ('xml'), ('qr'), ('model'), ('computed')) d(reader) LEFT JOIN (
  SELECT CASE source WHEN 'ubl_xml' THEN 'xml' WHEN 'qr' THEN 'qr' WHEN 'vlm' THEN 'model' WHEN 'computed' THEN 'computed' END AS reader FROM {fields}
  WHERE trim(coalesce(value_final, value_extracted)) <> '') f ON f.reader = d.reader GROUP BY d.reader""")
def ag_sources(fields):
    """Non-blank fields of each reader, zero-filled; human and rule sources aren't readers."""
    names = F.create_map(*[F.lit(x) for kv in (("ubl_xml", "xml"), ("qr", "qr"), ("vlm", "model"), ("computed", "computed")) for x in kv])
    counts = fields.where(F.trim(effective()) != "").groupBy(F.try_element_at(names, F.col("source")).alias("reader")).agg(F.count(F.lit(1)).alias("n"))
    domain = fields.sparkSession.createDataFrame([("xml",), ("qr",), ("model",), ("computed",)], "reader string")
    return domain.join(counts, "reader", "left").fillna(0, ["n"])


@op("ag_line_sum", "inv_lines", oracle="""SELECT annotation_id, CAST(sum(coalesce(quantity * unit_price, line_amount)) AS DOUBLE) AS line_sum, count(coalesce(quantity * unit_price, line_amount)) AS usable
  FROM {inv_lines} GROUP BY annotation_id""")
def ag_line_sum(inv_lines):
    amount = F.coalesce(F.col("quantity") * F.col("unit_price"), F.col("line_amount"))
    return inv_lines.groupBy("annotation_id").agg(F.sum(amount).cast("double").alias("line_sum"), F.count(amount).alias("usable"))


@op("ag_blockers", "findings", oracle="""SELECT annotation_id, string_agg(rule_code, ',' ORDER BY first) AS blockers FROM (
  SELECT annotation_id, rule_code, min(pos) AS first FROM (SELECT *, row_number() OVER (PARTITION BY annotation_id ORDER BY line_no, part_no, supp_no, message_en) AS pos FROM {findings}) p
  WHERE severity = 'error' AND NOT passed GROUP BY ALL) q GROUP BY annotation_id""")
def ag_blockers(findings):
    """Distinct blocking codes of each annotation, first seen first."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "part_no", "supp_no", "message_en", "rule_code")))
    per = findings.where("severity = 'error' AND NOT passed").groupBy("annotation_id").agg(ordered.alias("all"))
    return per.select("annotation_id", F.array_join(F.array_distinct(F.transform("all", lambda x: x["rule_code"])), ",").alias("blockers"))


def _keys(findings, severity):
    failed = findings.where((F.col("severity") == severity) & ~F.col("passed") & F.col("field_key").isNotNull())
    return failed.groupBy("annotation_id").agg(F.array_join(F.array_sort(F.collect_set("field_key")), ",").alias("keys"))


def _keys_sql(severity):
    return f"""SELECT annotation_id, string_agg(field_key, ',' ORDER BY field_key) AS keys FROM (SELECT DISTINCT annotation_id, field_key FROM {{findings}}
      WHERE severity = '{severity}' AND NOT passed AND field_key IS NOT NULL) k GROUP BY annotation_id"""


@op("ag_blocking_keys", "findings", oracle=_keys_sql("error"))
def ag_blocking_keys(findings):
    return _keys(findings, "error")


@op("ag_warned_keys", "findings", oracle=_keys_sql("warning"))
def ag_warned_keys(findings):
    return _keys(findings, "warning")


@op("ag_any_usable", "fields", "specs", oracle="""SELECT f.annotation_id, bool_or(f.bbox_page IS NOT NULL) AS any_usable,
  bool_or(coalesce(s.required, false) AND coalesce(trim(coalesce(f.value_final, f.value_extracted)), '') = '') AS missing_required
  FROM {fields} f LEFT JOIN {specs} s ON s.field_key = f.field_key WHERE f.row_index IS NULL GROUP BY f.annotation_id""")
def ag_any_usable(fields, specs):
    joined = fields.where("row_index IS NULL").join(F.broadcast(specs.select("field_key", "required")), "field_key", "left")
    blank = F.coalesce(F.trim(effective()), F.lit("")) == ""
    return joined.groupBy("annotation_id").agg(F.bool_or(F.col("bbox_page").isNotNull()).alias("any_usable"), F.bool_or(F.coalesce("required", F.lit(False)) & blank).alias("missing_required"))


@op("ag_page_text", "conversations", oracle="SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE text <> '') AS text FROM {conversations} GROUP BY conv_id")
def ag_page_text(conversations):
    """Texts of a document's pages in order, empty ones left out."""
    pages = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("turn", "text"))))
    per = conversations.groupBy("conv_id").agg(pages.alias("pages"))
    return per.select("conv_id", F.when(F.size("pages") > 0, F.array_join(F.transform("pages", lambda p: p["text"]), "\n")).alias("text"))


TALLY = ("correct", "wrong", "null_miss", "silent_miss", "false_value", "wrong_but_flagged")
TALLY_SQL = """count(*) FILTER (WHERE expected IS NOT DISTINCT FROM got) AS correct, count(*) FILTER (WHERE expected <> got) AS wrong,
  count(*) FILTER (WHERE expected IS NOT NULL AND got IS NULL) AS null_miss, count(*) FILTER (WHERE expected IS NOT NULL AND got IS NULL AND NOT flagged) AS silent_miss,
  count(*) FILTER (WHERE expected IS NULL AND got IS NOT NULL) AS false_value, count(*) FILTER (WHERE expected <> got AND flagged) AS wrong_but_flagged"""


def tally_columns():
    expected, got, flagged = F.col("expected"), F.col("got"), F.col("flagged")
    wrong, miss = F.coalesce(expected != got, F.lit(False)), expected.isNotNull() & got.isNull()
    conds = (expected.eqNullSafe(got), wrong, miss, miss & ~flagged, expected.isNull() & got.isNotNull(), wrong & flagged)
    return [F.count_if(c).alias(n) for c, n in zip(conds, TALLY, strict=True)]


@op("ag_tally", "readings", oracle=f"SELECT field_key, {TALLY_SQL} FROM {{readings}} GROUP BY field_key")
def ag_tally(readings):
    return readings.groupBy("field_key").agg(*tally_columns())


@op("ag_tally_groups", "readings", oracle=f"SELECT field_key, producer, path, {TALLY_SQL} FROM {{readings}} GROUP BY GROUPING SETS ((field_key), (producer, field_key), (path, field_key), ())")
def ag_tally_groups(readings):
    """Tallies by field, by producer and field, by path and field, and overall, in one pass."""
    f, p, t = F.col("field_key"), F.col("producer"), F.col("path")
    return readings.groupingSets([[f], [p, f], [t, f], []], f, p, t).agg(*tally_columns())


RATE = "CASE WHEN {w} > 0 THEN CAST({p} AS DOUBLE) / {w} END"


def _rate(part, whole):
    return F.try_divide(part.cast("double"), whole)


@op("ag_scoreboard", "outcomes", oracle="""SELECT run, CAST(correct AS DOUBLE) / n AS accuracy, CASE WHEN bad > 0 THEN CAST(caught AS DOUBLE) / bad END AS catch_rate,
  CASE WHEN bad > 0 THEN CAST(not_green AS DOUBLE) / bad END AS not_green_rate, CASE WHEN correct_ex > 0 THEN CAST(alarms AS DOUBLE) / correct_ex END AS false_alarm_rate FROM (
  SELECT run, count(*) AS n, count(*) FILTER (WHERE status = 'correct') AS correct, count(*) FILTER (WHERE status <> 'correct' AND field <> 'es') AS bad,
    count(*) FILTER (WHERE status <> 'correct' AND field <> 'es' AND rule_flagged) AS caught, count(*) FILTER (WHERE status <> 'correct' AND field <> 'es' AND NOT shown_green) AS not_green,
    count(*) FILTER (WHERE status = 'correct' AND field <> 'es') AS correct_ex, count(*) FILTER (WHERE status = 'correct' AND field <> 'es' AND rule_flagged) AS alarms FROM {outcomes} GROUP BY run) t""")
def ag_scoreboard(outcomes):
    return scoreboard(outcomes, ["run"], exclude=("es",))


def scoreboard(outcomes, by, exclude=()):
    """Accuracy over all fields; catch, not-green and false-alarm rates without the excluded ones. A rate over nothing is null."""
    right, kept = F.col("status") == "correct", ~F.col("field").isin(*exclude) if exclude else F.lit(True)
    n = lambda c: F.count_if(c)
    bad, good = ~right & kept, right & kept
    return outcomes.groupBy(*by).agg(
        _rate(n(right), F.count(F.lit(1))).alias("accuracy"), _rate(n(bad & F.col("rule_flagged")), n(bad)).alias("catch_rate"),
        _rate(n(bad & ~F.col("shown_green")), n(bad)).alias("not_green_rate"), _rate(n(good & F.col("rule_flagged")), n(good)).alias("false_alarm_rate"),
    )


@op("ag_total_row", "outcomes", oracle="""SELECT run, coalesce(field, 'ALL') AS field, count(*) FILTER (WHERE status = 'correct') AS correct, count(*) FILTER (WHERE status = 'wrong') AS wrong,
  count(*) FILTER (WHERE status = 'missing') AS missing, count(*) AS n FROM {outcomes} GROUP BY GROUPING SETS ((run, field), (run))""")
def ag_total_row(outcomes):
    run, field = F.col("run"), F.col("field")
    rows = outcomes.groupingSets([[run, field], [run]], run, field).agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("correct", "wrong", "missing")], F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g")
    )
    return rows.select("run", F.when(F.col("g") > 0, "ALL").otherwise(field).alias("field"), "correct", "wrong", "missing", "n")


CAUSES = ("misread", "label_style", "wrong_field", "empty", "unclassified")


@op("ag_error_matrix", "readings", oracle="SELECT coalesce(field_key, 'All') AS field, " + ", ".join(f"count(*) FILTER (WHERE cause = '{c}') AS {c}" for c in CAUSES)
    + f", count(*) AS total FROM ({CAUSES_SQL}) c GROUP BY ROLLUP (field_key)")
def ag_error_matrix(readings):
    """Wrong fields by cause, as classified, with a row for all fields."""
    rows = error_causes(readings).rollup("field_key").agg(*[F.count_if(F.col("cause") == c).alias(c) for c in CAUSES], F.count(F.lit(1)).alias("total"), F.grouping_id().alias("g"))
    return rows.select(F.when(F.col("g") == 1, "All").otherwise(F.col("field_key")).alias("field"), *CAUSES, "total")


@op("ag_settled_wrong", "outcomes", oracle="SELECT run, count(*) FILTER (WHERE status <> 'correct' AND NOT rule_flagged AND shown_green) AS settled_wrong FROM {outcomes} GROUP BY run")
def ag_settled_wrong(outcomes):
    return outcomes.groupBy("run").agg(F.count_if((F.col("status") != "correct") & ~F.col("rule_flagged") & F.col("shown_green")).alias("settled_wrong"))


@op("ag_shared_errors", "outcomes", oracle="""SELECT a.field, count(*) FILTER (WHERE a.status <> 'correct' AND b.status <> 'correct') AS both_wrong,
  count(*) FILTER (WHERE a.status <> 'correct' AND b.status = 'correct') AS only_a, count(*) FILTER (WHERE a.status = 'correct' AND b.status <> 'correct') AS only_b,
  count(*) FILTER (WHERE a.status = 'wrong' AND b.status = 'wrong') AS same_kind FROM {outcomes} a JOIN {outcomes} b ON a.doc_id = b.doc_id AND a.run = 1 AND b.run = 2 GROUP BY a.field""")
def ag_shared_errors(outcomes):
    a = outcomes.where("run = 1").select("doc_id", "field", F.col("status").alias("a"))
    b = outcomes.where("run = 2").select("doc_id", F.col("status").alias("b"))
    wrong_a, wrong_b = F.col("a") != "correct", F.col("b") != "correct"
    return a.join(b, "doc_id").groupBy("field").agg(
        F.count_if(wrong_a & wrong_b).alias("both_wrong"), F.count_if(wrong_a & ~wrong_b).alias("only_a"), F.count_if(~wrong_a & wrong_b).alias("only_b"),
        F.count_if((F.col("a") == "wrong") & (F.col("b") == "wrong")).alias("same_kind"),
    )


@op("ag_question_counts", "conversations", oracle="""SELECT question, n FROM (SELECT trim(regexp_replace(regexp_replace(lower(text), '[.,;:!?()]', ' ', 'g'), '\\s+', ' ', 'g')) AS question,
  count(DISTINCT conv_id) AS n FROM {conversations} WHERE role = 'user' GROUP BY ALL) q ORDER BY n DESC, question LIMIT 20""")
def ag_question_counts(conversations):
    """How many conversations ask each normalized question, the twenty most frequent."""
    question = S.collapse(F.regexp_replace(F.lower("text"), "[.,;:!?()]", " "))
    asked = conversations.where("role = 'user'").groupBy(question.alias("question")).agg(F.countDistinct("conv_id").alias("n"))
    return asked.orderBy(F.desc("n"), "question").limit(20)


@op("ag_gt_coverage", "readings", oracle="SELECT coalesce(field_key, 'total') AS field, count(DISTINCT annotation_id) AS receipts FROM {readings} WHERE expected IS NOT NULL GROUP BY ROLLUP (field_key)")
def ag_gt_coverage(readings):
    rows = readings.where("expected IS NOT NULL").rollup("field_key").agg(F.countDistinct("annotation_id").alias("receipts"), F.grouping_id().alias("g"))
    return rows.select(F.when(F.col("g") == 1, "total").otherwise(F.col("field_key")).alias("field"), "receipts")


@op("ag_frag_ratios", "documents", oracle="""SELECT doc_id, CASE WHEN n >= 20 THEN CAST(len(list_filter(w, lambda x: length(x) <= 2)) AS DOUBLE) / n END AS single,
  CASE WHEN n >= 20 THEN CAST(len(list_filter(w, lambda x: starts_with(x, 'th'))) AS DOUBLE) / n END AS article FROM (
  SELECT doc_id, string_split(text, ' ') AS w, len(string_split(text, ' ')) AS n FROM {documents}) t""")
def ag_frag_ratios(documents):
    """The fragmentation shares with stand-ins for the script: words of two letters at most, words that begin with 'th'."""
    w = F.split("text", " ")
    share = lambda cond: F.when(F.size(w) >= 20, F.size(F.filter(w, cond)) / F.size(w))
    return documents.select("doc_id", share(lambda x: F.length(x) <= 2).alias("single"), share(lambda x: x.startswith("th")).alias("article"))


def bucket_sql(c):
    """The bucket of a column, spelt out for the oracle from the golden edges."""
    edges = ("0.05", "0.10", "0.15", "0.20", "0.30", "0.50", "1.00")
    return "CASE " + " ".join(f"WHEN {c} < {e} THEN '<{e}'" for e in edges) + " ELSE '>=1.00' END"


@op("ag_gap_histogram", "words", oracle=f"""SELECT doc_id, {bucket_sql('g')} AS bucket, non_joining, count(*) AS n FROM (SELECT doc_id, CAST(x0 - lag(x1) OVER w AS DOUBLE) / (y1 - y0) AS g, right(word, 1) IN ('e', 'r') AS non_joining
  FROM {{words}} WINDOW w AS (PARTITION BY doc_id, line ORDER BY x0, pos)) t WHERE g IS NOT NULL GROUP BY ALL""")
def ag_gap_histogram(words):
    """Per page: gaps between neighbours in units of the line's height, by whether the right word ends in a letter that never joins (stand-ins here)."""
    w = W.partitionBy("doc_id", "line").orderBy("x0", "pos")
    gap = (F.col("x0") - F.lag("x1").over(w)).cast("double") / (F.col("y1") - F.col("y0"))
    gaps = words.select("doc_id", gap.alias("g"), F.right("word", F.lit(1)).isin("e", "r").alias("non_joining")).where("g IS NOT NULL")
    return gaps.groupBy("doc_id", S.bucket(F.col("g")).alias("bucket"), "non_joining").agg(F.count(F.lit(1)).alias("n"))


@op("ag_seed_stats", "fields", oracle="""SELECT annotation_id, count(*) AS total, count(*) FILTER (WHERE bbox_page IS NOT NULL) AS boxed, count(*) FILTER (WHERE row_index IS NOT NULL) AS line_cells,
  count(*) FILTER (WHERE validation_state = 'blocking') AS blocking FROM {fields} GROUP BY annotation_id""")
def ag_seed_stats(fields):
    return fields.groupBy("annotation_id").agg(
        F.count(F.lit(1)).alias("total"), F.count("bbox_page").alias("boxed"), F.count("row_index").alias("line_cells"), F.count_if(F.col("validation_state") == "blocking").alias("blocking")
    )


@op("ag_prov_summary", "fields", oracle=f"""SELECT annotation_id, kind, count(*) AS n, list_position(['mismatch', 'verified', 'qr', 'human', 'extracted', 'derived', 'absent'], kind) AS place
  FROM (SELECT annotation_id, {PROVENANCE} AS kind FROM {{fields}}) k GROUP BY annotation_id, kind""")
def ag_prov_summary(fields):
    """Fields of each provenance kind, with the kind's fixed place in the order shown."""
    kinds = F.array(*map(F.lit, ("mismatch", "verified", "qr", "human", "extracted", "derived", "absent")))
    counted = fields.groupBy("annotation_id", provenance().alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("place", F.array_position(kinds, F.col("kind")).cast("int"))


@op("ag_progress", "docs", "annotations", oracle="WITH " + LATEST_SQL + " SELECT count(*) FILTER (WHERE st NOT IN ('processing', 'importing')) AS finished, count(*) AS total FROM state")
def ag_progress(docs, annotations):
    return document_states(docs, annotations).agg(F.count_if(~F.col("st").isin("processing", "importing")).alias("finished"), F.count(F.lit(1)).alias("total"))


@op("ag_legacy_summary", "documents", oracle="SELECT count(*) AS n_rows, count(*) FILTER (WHERE n_chars < 200) AS failures FROM {documents}")
def ag_legacy_summary(documents):
    return documents.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("n_chars") < 200).alias("failures"))
