"""Window-shaped operators: latest per group, islands, running reach, n-grams, neighbours."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.operators.reading import has_letter, join_wrapped, page_direction, reading_order, segment, split_columns, windows
from ledgerlens.plans.catalog import op
from ledgerlens.plans.relations import REVIEWER_SQL, last_reviewers


@op("wn_max_over", "schemas", oracle="SELECT id, queue_id, version, version = max(version) OVER (PARTITION BY queue_id) AS in_use FROM {schemas}")
def wn_max_over(schemas):
    return schemas.select("id", "queue_id", "version", (F.col("version") == F.max("version").over(W.partitionBy("queue_id"))).alias("in_use"))


@op("wn_distinct_on", "corrections", oracle="WITH " + REVIEWER_SQL + " SELECT annotation_id, field_key, row_index, user_id FROM reviewers")
def wn_distinct_on(corrections):
    return last_reviewers(corrections)


@op("wn_latest_schema", "schemas", oracle="SELECT queue_id, id, version FROM (SELECT *, row_number() OVER (PARTITION BY queue_id ORDER BY version DESC, id DESC) AS n FROM {schemas}) s WHERE n = 1")
def wn_latest_schema(schemas):
    top = schemas.groupBy("queue_id").agg(F.max(F.struct("version", "id")).alias("top"))
    return top.select("queue_id", "top.id", "top.version")


@op("wn_first_queue", "docs", oracle="SELECT org_id, queue_id FROM (SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY created_at, id) AS n FROM {docs}) d WHERE n = 1")
def wn_first_queue(docs):
    first = docs.groupBy("org_id").agg(F.min_by("queue_id", F.struct("created_at", "id")).alias("queue_id"))
    return first.select("org_id", "queue_id")


# The driver's texts are Latin: words that end in certain letters play the other script's part.
def stand_in_rtl(word):
    return F.right(word, F.lit(1)).isin("e", "n")


def stand_in_ltr(word):
    return has_letter(word) & ~stand_in_rtl(word)


def stand_in_non_joining(word):
    return F.right(word, F.lit(1)).isin("e", "r")


RTL_SQL = "right(word, 1) IN ('e', 'n')"
LETTER_SQL = "regexp_matches(word, '\\pL')"
LTR_SQL = f"({LETTER_SQL} AND NOT {RTL_SQL})"
BLANK_SQL = "regexp_matches({w}, '^[\\s\\x0B\\x85\\pZ]*$')"


@op("wn_segment", "words", oracle=f"""SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY begin_at) - 1 AS island, word FROM (
  SELECT doc_id, line, island, min(pos) AS begin_at, string_agg(word, '' ORDER BY pos) AS word FROM (
    SELECT *, sum(CASE WHEN {BLANK_SQL.format(w='word')} OR {BLANK_SQL.format(w='pw')} OR x0 - px1 > (CASE WHEN right(pw, 1) IN ('e', 'r') THEN 1.1 ELSE 0.5 END) * ((x1 - x0) + pwid) / 2.0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, line ORDER BY pos) AS island FROM (
      SELECT *, lag(x1) OVER w AS px1, lag(word) OVER w AS pw, lag(x1 - x0) OVER w AS pwid FROM {{words}} WINDOW w AS (PARTITION BY doc_id, line ORDER BY pos)) a) b
  WHERE NOT {BLANK_SQL.format(w='word')} GROUP BY doc_id, line, island) c""")
def wn_segment(words):
    """Glyphs (here words) join until a space or a gap beyond a factor of the mean width of the two beside it."""
    return segment(words, ["doc_id", "line"], order="pos", non_joining=stand_in_non_joining)


@op("wn_column_split", "words", oracle=f"""SELECT doc_id, line, pos, CAST(sum(CASE WHEN cuts AND x0 - reach > 10 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, line ORDER BY x0, x1, pos) AS INT) AS island FROM (
  SELECT *, max(x1) OVER (PARTITION BY doc_id, line ORDER BY x0, x1, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach, bool_or({RTL_SQL}) OVER (PARTITION BY doc_id, line) AS cuts FROM {{words}}) t""")
def wn_column_split(words):
    """Cut a line with a right-to-left word where a word begins half a line's height beyond the furthest edge so far."""
    return split_columns(words, ["doc_id", "line"], order="pos", rtl=stand_in_rtl).select("doc_id", "line", "pos", "island")


@op("wn_runs", "words", oracle=f"""WITH d AS (SELECT doc_id, count(*) FILTER (WHERE {RTL_SQL}) > count(*) FILTER (WHERE {LTR_SQL}) AS page_rtl FROM {{words}} GROUP BY doc_id),
  k AS (SELECT *, {RTL_SQL} AS rtl, {LETTER_SQL} AS letter, bool_or({RTL_SQL}) OVER (PARTITION BY doc_id, line) AS mixed FROM {{words}}),
  s AS (SELECT *, rtl OR (NOT letter AND coalesce(lag(rtl) OVER v AND lead(rtl) OVER v, false)) AS kind, row_number() OVER v AS seen FROM k WINDOW v AS (PARTITION BY doc_id, line ORDER BY x0, x1, pos)),
  i AS (SELECT *, sum(CASE WHEN kind IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, line ORDER BY x0, x1, pos) AS run FROM (SELECT *, lag(kind) OVER (PARTITION BY doc_id, line ORDER BY x0, x1, pos) AS p FROM s) q)
  SELECT i.doc_id, line, pos, CAST(row_number() OVER (PARTITION BY i.doc_id, line ORDER BY CASE WHEN mixed THEN CASE WHEN page_rtl THEN -run ELSE run END END, CASE WHEN mixed AND kind THEN -seen ELSE pos END) AS INT) AS place FROM i JOIN d ON d.doc_id = i.doc_id""")
def wn_runs(words):
    """Reading order of each line: runs of one direction, as the page's direction has them."""
    pages = page_direction(words, ["doc_id"], rtl=stand_in_rtl, ltr=stand_in_ltr)
    return reading_order(words.join(pages, "doc_id"), ["doc_id", "line"], F.col("rtl"), order="pos", rtl=stand_in_rtl).select("doc_id", "line", "pos", "place")


@op("wn_page_dir", "words", oracle=f"SELECT doc_id, count(*) FILTER (WHERE {RTL_SQL}) > count(*) FILTER (WHERE {LTR_SQL}) AS rtl FROM {{words}} GROUP BY doc_id")
def wn_page_dir(words):
    return page_direction(words, ["doc_id"], rtl=stand_in_rtl, ltr=stand_in_ltr)


@op("wn_wrap_join", "words", oracle="""SELECT doc_id, string_agg(sep || word, '' ORDER BY pos) AS text FROM (SELECT doc_id, pos, word, CASE WHEN pw IS NULL OR (right(pw, 1) = ',' AND length(pw) >= 2
    AND regexp_matches(substr(pw, length(pw) - 1, 1), '^[\\pL\\pN]$') AND regexp_matches(substr(word, 1, 1), '^[\\pL\\pN]$') AND NOT ends_with(word, ':') AND y0 - py0 >= 10 AND y0 - py1 <= 20) THEN '' ELSE ' ' END AS sep
  FROM (SELECT *, lag(word) OVER w AS pw, lag(y0) OVER w AS py0, lag(y1) OVER w AS py1 FROM {words} WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) l) t GROUP BY doc_id""")
def wn_wrap_join(words):
    """Words joined by a space, but for a value that wraps onto the line below (a comma plays the hyphen)."""
    return join_wrapped(words, ["doc_id"], order="pos", hyphen=",")


@op("wn_ngrams", "words", oracle="""SELECT doc_id, pos, n, gram FROM (SELECT doc_id, pos, 1 AS n, word AS gram FROM {words} UNION ALL
  SELECT doc_id, pos, 2, word || ' ' || lead(word) OVER w FROM {words} WINDOW w AS (PARTITION BY doc_id ORDER BY pos) UNION ALL
  SELECT doc_id, pos, 3, word || ' ' || lead(word, 1) OVER w || ' ' || lead(word, 2) OVER w FROM {words} WINDOW w AS (PARTITION BY doc_id ORDER BY pos) UNION ALL
  SELECT doc_id, pos, 4, word || ' ' || lead(word, 1) OVER w || ' ' || lead(word, 2) OVER w || ' ' || lead(word, 3) OVER w FROM {words} WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) g WHERE gram IS NOT NULL""")
def wn_ngrams(words):
    """All windows that a value of two words is compared with: one to four consecutive words."""
    return windows(words, ["doc_id"], 2, order="pos")


@op("wn_pairwise", "words", oracle="SELECT doc_id, pos, x0 - lag(x1) OVER (PARTITION BY doc_id, line ORDER BY x0, pos) AS gap FROM {words}")
def wn_pairwise(words):
    w = W.partitionBy("doc_id", "line").orderBy("x0", "pos")
    return words.select("doc_id", "pos", (F.col("x0") - F.lag("x1").over(w)).cast("long").alias("gap"))


@op("wn_batch_coalesce", "corrections", oracle="""SELECT annotation_id, field_key, row_index, id, action, new_value FROM (
  SELECT *, row_number() OVER (PARTITION BY annotation_id, field_key, row_index ORDER BY id DESC) AS n FROM {corrections}) c WHERE n = 1""")
def wn_batch_coalesce(corrections):
    last = corrections.groupBy("annotation_id", "field_key", "row_index").agg(F.max(F.struct("id", "action", "new_value")).alias("last"))
    return last.select("annotation_id", "field_key", "row_index", "last.*")


@op("wn_next_blocker", "fields", oracle="""WITH b AS (SELECT annotation_id, field_key, coalesce(row_index, -1) AS r FROM {fields} WHERE validation_state = 'blocking')
  SELECT annotation_id, field_key, r AS row_index, coalesce(lead(field_key) OVER w, first_value(field_key) OVER w) AS next_key FROM b WINDOW w AS (PARTITION BY annotation_id ORDER BY field_key, r)""")
def wn_next_blocker(fields):
    """The blocking field after each one, wrapping to the first."""
    blocking = fields.where("validation_state = 'blocking'").select("annotation_id", "field_key", F.coalesce("row_index", F.lit(-1)).alias("row_index"))
    w = W.partitionBy("annotation_id").orderBy("field_key", "row_index")
    return blocking.withColumn("next_key", F.coalesce(F.lead("field_key").over(w), F.first("field_key").over(w)))
