"""Evaluation: value matching of three kinds, scores, error causes, sampling and grounding."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import fuzzy
from ledgerlens.functions import scalars as S
from ledgerlens.operators.ranking import global_rank
from ledgerlens.plans.catalog import op
from ledgerlens.session import arrow_pass, materialize

AMOUNT_FIELDS, DATE_FIELDS, CODE_FIELDS = ("subtotal", "vat_amount", "total_amount"), ("issue_date",), ("invoice_number", "seller_trn", "buyer_trn")
FUZZY_FROM, NEAR = 85.0, 0.75


@op("sc_parse_amount", "orders", oracle="""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 2 THEN CAST(floor(o_totalprice) AS DOUBLE) WHEN 3 THEN NULL ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) END AS amount FROM {orders}""")
def sc_parse_amount(orders):
    """Currency noise and grouping are tolerated; a decimal comma ends the number; no digits: null."""
    k, cents = F.col("o_orderkey") % 4, F.col("o_totalprice").cast("decimal(18,2)")
    text = (
        F.when(k == 0, F.concat(F.lit("LE "), F.format_number(cents, 2))).when(k == 1, F.concat(F.lit("*"), cents.cast("string"), F.lit(" EGP")))
        .when(k == 2, F.concat(F.floor("o_totalprice").cast("string"), F.lit(",4"))).otherwise("none")
    )
    return orders.select("o_orderkey", S.parse_amount(text).cast("double").alias("amount"))


@op("sc_date_readings", "orders", oracle="""SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 1 THEN 1 WHEN day(o_orderdate) <= 12 AND day(o_orderdate) <> month(o_orderdate) THEN 2 ELSE 1 END::BIGINT AS n FROM {orders}""")
def sc_date_readings(orders):
    """All dates a text could mean: two where day and month could be exchanged."""
    k, d = F.col("o_orderkey") % 4, F.col("o_orderdate")
    text = F.when(k == 0, F.date_format(d, "yyyy.MM.dd")).when(k == 1, F.date_format(d, "d/M/yyyy")).when(k == 2, F.date_format(d, "d MMM yyyy")).otherwise(F.date_format(d, "MMMM d, yyyy"))
    return orders.select("o_orderkey", F.size(S.date_readings(text)).cast("long").alias("n"))


@op("sc_eval_name", "part", oracle="SELECT p_partkey, p_name || ' co' AS name FROM {part}")
def sc_eval_name(part):
    return part.select("p_partkey", S.eval_name(S.match_form(F.concat(F.upper("p_name"), F.lit(" (Co.)")))).alias("name"))


@op("sc_eval_code", "customer", oracle="SELECT c_custkey, 'customer' || substr(c_name, 10) AS code FROM {customer}")
def sc_eval_code(customer):
    return customer.select("c_custkey", S.eval_code(F.col("c_name")).alias("code"))


def same_answer(field: Column, predicted: Column, answer: Column) -> Column:
    """Exact after normalization by the field's kind; a blank value never is."""
    by_amount = S.parse_amount(predicted) == S.parse_amount(answer)
    by_date = F.arrays_overlap(S.date_readings(predicted), S.date_readings(answer))
    code = S.eval_code(predicted)
    name = S.eval_name(S.match_form(predicted))
    by_code, by_name = (code != "") & (code == S.eval_code(answer)), (name != "") & (name == S.eval_name(S.match_form(answer)))
    kind = F.when(field.isin(*AMOUNT_FIELDS), by_amount).when(field.isin(*DATE_FIELDS), by_date).when(field.isin(*CODE_FIELDS), by_code).otherwise(by_name)
    return F.coalesce((F.trim(predicted) != "") & kind, F.lit(False))


def matches(field: Column, predicted: Column, acceptable: Column) -> Column:
    """Whether the value is the same as any acceptable answer (an array)."""
    return F.coalesce(F.exists(acceptable, lambda a: same_answer(field, predicted, a)), F.lit(False))


_MATCH_SQL = """CASE WHEN got IS NULL OR trim(got) = '' THEN false
  WHEN field_key IN ('subtotal', 'vat_amount', 'total_amount') THEN coalesce(TRY_CAST(got AS DECIMAL(38,10)) = TRY_CAST(expected AS DECIMAL(38,10)), false)
  WHEN field_key = 'issue_date' THEN coalesce(length(got) = 10 AND got = expected, false)
  WHEN field_key IN ('invoice_number', 'seller_trn', 'buyer_trn') THEN coalesce(regexp_replace(lower(got), '[^0-9a-z]', '', 'g') = regexp_replace(lower(expected), '[^0-9a-z]', '', 'g'), false)
  ELSE coalesce(lower(got) = lower(expected), false) END"""


@op("sc_matches", "readings", oracle=f"SELECT annotation_id, field_key, {_MATCH_SQL} AS correct FROM {{readings}} WHERE expected IS NOT NULL")
def sc_matches(readings):
    rows = readings.where("expected IS NOT NULL")
    return rows.select("annotation_id", "field_key", same_answer(F.col("field_key"), F.col("got"), F.col("expected")).alias("correct"))


@op("sc_score_field", "readings", oracle=f"SELECT annotation_id, field_key, CASE WHEN got IS NULL OR trim(got) = '' THEN 'missing' WHEN {_MATCH_SQL} THEN 'correct' ELSE 'wrong' END AS status, flagged FROM {{readings}} WHERE expected IS NOT NULL")
def sc_score_field(readings):
    return scored(readings.where("expected IS NOT NULL")).select("annotation_id", "field_key", "status", "flagged")


def scored(rows: DataFrame) -> DataFrame:
    missing = F.col("got").isNull() | (F.trim("got") == "")
    right = same_answer(F.col("field_key"), F.col("got"), F.col("expected"))
    return rows.withColumn("status", F.when(missing, "missing").when(right, "correct").otherwise("wrong"))


@op("sc_fuzzy_name", "part", oracle="SELECT p_partkey, true AS contained, p_partkey % 4 = 0 AS same FROM {part}")
def sc_fuzzy_name(part):
    """A short name inside a longer one scores full marks; an unrelated name stays below the bar."""
    long_form = F.concat(F.lit("the "), F.col("p_name"), F.lit(" trading company"))
    other = F.when(F.col("p_partkey") % 4 == 0, F.col("p_name")).otherwise(F.lit("zzz qqq"))
    return part.select("p_partkey", (fuzzy.token_set(F.col("p_name"), long_form) >= FUZZY_FROM).alias("contained"), (fuzzy.token_set(F.col("p_name"), other) >= FUZZY_FROM).alias("same"))


@op("sc_ratio", "part", oracle="SELECT p_partkey, 200.0 * length(p_name) / (2 * length(p_name) + 3) AS ratio FROM {part}")
def sc_ratio(part):
    """Normalized insertion-deletion similarity: three added characters leave a common subsequence of the whole name."""
    return part.select("p_partkey", fuzzy.ratio(F.col("p_name"), F.concat(F.col("p_name"), F.lit("###"))).alias("ratio"))


@op("sc_lev_sim", "part", oracle="SELECT p_partkey, 1.0::DOUBLE - CAST(levenshtein(p_name, p_type) AS DOUBLE) / greatest(length(p_name), length(p_type)) >= 0.25 AS near, 1.0::DOUBLE - CAST(levenshtein(p_name, p_type) AS DOUBLE) / greatest(length(p_name), length(p_type)) AS similarity FROM {part}")
def sc_lev_sim(part):
    similarity = S.levenshtein_similarity(F.col("p_name"), F.col("p_type"))
    return part.select("p_partkey", (similarity >= 0.25).alias("near"), similarity.alias("similarity"))


def same_tokens_one_way(a: Column, b: Column) -> Column:
    x, y = (F.split(S.eval_name(S.match_form(c)), " ") for c in (a, b))
    return (F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0)


def classify_error(field: Column, predicted: Column, truth: Column, other: Column) -> Column:
    """The cause of a wrong field, in strict order: empty, label style, another field's value, misread, unclassified.

    ``other`` is the answer of another question of the same document.
    """
    amount, date, code = field.isin(*AMOUNT_FIELDS), field.isin(*DATE_FIELDS), field.isin(*CODE_FIELDS)
    equal = lambda a, b: same_answer(field, a, b)
    style = (amount & (S.parse_amount(truth).isNull() | ((S.digits(predicted) != "") & (S.digits(predicted) == S.digits(truth))))) | (date & (F.size(S.date_readings(truth)) == 0))
    two = lambda c: S.money_text(S.parse_amount(c))
    near = (
        F.when(amount, S.levenshtein_similarity(two(predicted), two(truth)))
        .when(code, S.levenshtein_similarity(S.eval_code(predicted), S.eval_code(truth)))
        .otherwise(S.levenshtein_similarity(predicted, truth))
    ) >= NEAR
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(predicted.isNull() | (F.trim(predicted) == ""), "empty").when(yes(style), "label_style").when(yes(equal(predicted, other)), "wrong_field")
        .when(yes((field == "seller_name") & same_tokens_one_way(predicted, truth)), "label_style").when(yes(near), "misread").otherwise("unclassified")
    )


#: Wrong codes and currencies with their cause, restated (their other answer never is another field's, and their truth is always given).
CAUSES_SQL = """WITH w AS (SELECT r.*, o.expected AS other FROM {readings} r LEFT JOIN (SELECT annotation_id, expected FROM {readings} WHERE field_key = 'currency') o ON o.annotation_id = r.annotation_id
    WHERE r.expected IS NOT NULL AND r.expected IS DISTINCT FROM r.got AND r.field_key IN ('invoice_number', 'seller_trn', 'buyer_trn', 'currency'))
  SELECT annotation_id, field_key, CASE WHEN got IS NULL THEN 'empty' WHEN 1.0 - CAST(levenshtein(c, d) AS DOUBLE) / greatest(length(c), length(d)) >= 0.75 THEN 'misread' ELSE 'unclassified' END AS cause FROM (
  SELECT *, CASE WHEN field_key = 'currency' THEN got ELSE regexp_replace(lower(got), '[^0-9a-z]', '', 'g') END AS c, CASE WHEN field_key = 'currency' THEN expected ELSE regexp_replace(lower(expected), '[^0-9a-z]', '', 'g') END AS d FROM w) t"""


def error_causes(readings: DataFrame) -> DataFrame:
    other = readings.where("field_key = 'currency'").select("annotation_id", F.col("expected").alias("other"))
    wrong = readings.where("expected IS NOT NULL AND NOT (expected <=> got)").where(F.col("field_key").isin("invoice_number", "seller_trn", "buyer_trn", "currency"))
    cause = classify_error(F.col("field_key"), F.col("got"), F.col("expected"), F.when(F.col("field_key") != "currency", F.col("other")))
    return wrong.join(other, "annotation_id", "left").select("annotation_id", "field_key", cause.alias("cause"))


@op("sc_classify_error", "readings", oracle=CAUSES_SQL)
def sc_classify_error(readings):
    return error_causes(readings)


def bench_same(field: Column, expected: Column, got: Column) -> Column:
    """The benchmark's equality: money within half a cent, dates by their digit groups, currency synonyms, text without punctuation."""
    bare = lambda c: F.regexp_replace(S.numerals(c), r"[^0-9.\-]", "").try_cast(S.MONEY)
    folded = lambda c: F.regexp_replace(S.match_form(c), r"(?U)[\W_]+", "")
    groups = lambda c: F.regexp_extract_all(S.numerals(c), F.lit(r"(\d+)"), 1)

    def day(c: Column) -> Column:
        g = groups(c)
        parts = F.when(F.length(F.get(g, F.lit(0))) == 4, g).when(F.length(F.get(g, F.lit(2))) == 4, F.reverse(g))
        return F.when(F.size(g) == 3, F.concat_ws("-", F.get(parts, F.lit(0)), F.lpad(F.get(parts, F.lit(1)), 2, "0"), F.lpad(F.get(parts, F.lit(2)), 2, "0")))

    def currency(c: Column) -> Column:
        return F.when(F.lower(c).rlike("sar|riyal|ريال|ر\\.س|sr"), "SAR").otherwise(F.lower(c))

    money = F.abs(bare(expected) - bare(got)) <= F.lit("0.005").cast("decimal(4,3)")
    by = F.when(field.isin(*AMOUNT_FIELDS), money).when(field == "issue_date", day(expected) == day(got)).when(field == "currency", currency(expected).eqNullSafe(currency(got)))
    return F.coalesce(by.otherwise(folded(expected).eqNullSafe(folded(got))), F.lit(False))


@op("sc_bench_same", "readings", oracle="""SELECT annotation_id, field_key, CASE WHEN field_key IN ('subtotal', 'vat_amount', 'total_amount') THEN coalesce(abs(TRY_CAST(expected AS DECIMAL(38,10)) - TRY_CAST(got AS DECIMAL(38,10))) <= 0.005, false)
  WHEN field_key = 'issue_date' THEN coalesce(length(got) = 10 AND expected = got, false) WHEN field_key = 'currency' THEN (expected IS NULL) = (got IS NULL) ELSE expected IS NOT DISTINCT FROM got END AS same FROM {readings}""")
def sc_bench_same(readings):
    got = F.when(F.col("field_key") == "currency", F.when(F.col("got").isNotNull(), "Saudi Riyal")).otherwise(F.col("got"))
    got = F.when(F.col("field_key") == "issue_date", F.when(F.length("got") == 10, F.regexp_replace("got", r"(\d+)-(\d+)-(\d+)", "$3 - $2 - $1")).otherwise(F.lit("1 2"))).otherwise(got)
    return readings.select("annotation_id", "field_key", bench_same(F.col("field_key"), F.col("expected"), got).alias("same"))


@op("sc_ground_truth", "conversations", oracle="""WITH a AS (SELECT DISTINCT conv_id, CASE turn % 3 WHEN 0 THEN 'seller_name' WHEN 1 THEN 'invoice_number' END AS field, trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS answer FROM {conversations}),
  g AS (SELECT conv_id, field, count(*) AS n FROM a WHERE field IS NOT NULL AND trim(answer) <> '' GROUP BY ALL) SELECT conv_id, field, n FROM g WHERE n = 1 OR field = 'invoice_number'""")
def sc_ground_truth(conversations):
    """Distinct answers per field, first seen first; an ambiguous field goes, except the receipt number."""
    k = F.col("turn") % 3
    asked = F.when(k == 0, "What is the store name?").when(k == 1, "What is the receipt number?").otherwise("Is it good?")
    rows = conversations.select("conv_id", "turn", S.field_for(asked).alias("field"), F.regexp_replace("text", r"(?U)^\s+|\s+$", "").alias("answer")).where("field IS NOT NULL AND answer <> ''")
    answers = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("turn", "answer"))), lambda x: x["answer"]))
    per = rows.groupBy("conv_id", "field").agg(answers.alias("answers"))
    return per.where((F.size("answers") == 1) | (F.col("field") == "invoice_number")).select("conv_id", "field", F.size("answers").cast("long").alias("n"))


# What a receipt must answer to be drawn.
REQUIRED_FIELDS = ("seller_name", "issue_date", "total_amount")


def eligible_receipts(truth: DataFrame, key: str = "annotation_id", field: str = "field_key") -> DataFrame:
    """The receipts whose ground truth (a row per field that has one) answers every required field."""
    answered = truth.where(F.col(field).isin(*REQUIRED_FIELDS)).groupBy(key).agg(F.countDistinct(field).alias("n"))
    return answered.where(F.col("n") == len(REQUIRED_FIELDS)).select(key)


def choose_sample(ids: DataFrame, key: str, n: int, seed: int, exclude: DataFrame | None = None) -> DataFrame:
    """A fixed draw of n of the distinct ids, in order, none of them excluded; depends on the seed and the ids alone.

    The draw is Python's over the places 0 to N - 1 of the sorted ids, which is that over the ids
    themselves; so only their number and the n places drawn are on the driver.
    """
    pool = ids.select(key).where(F.col(key).isNotNull()).distinct()
    if exclude is not None:
        pool = pool.join(exclude.select(key), key, "left_anti")
    ranked = global_rank(pool, [F.asc(key)], "__place")
    total = ranked.count()
    if n > total:
        raise ValueError(f"asked for {n}, only {total} are eligible and not excluded")
    places = [i + 1 for i in random.Random(seed).sample(range(total), n)]
    return ranked.where(F.col("__place").isin(places)).select(key)


@op("sc_sample", "readings")
def sc_sample(readings):
    """A development draw of fifty receipts; the hundred of the test draw are held out."""
    eligible = materialize(eligible_receipts(readings.where("expected IS NOT NULL")), "eligible")
    test = choose_sample(eligible, "annotation_id", 100, seed=0)
    return choose_sample(eligible, "annotation_id", 50, seed=1, exclude=test)


#: Words whose comparing form a Python worker keeps.
MAX_FORMS = 200_000


def ground(values: DataFrame, words: DataFrame, cutoff: float = 85.0) -> DataFrame:
    """Each value's best matching window of words: doc_id, value, score, pos, n and its box.

    ``values``: doc_id, value. ``words``: doc_id, pos, word, x0, x1. Windows hold one
    to min(words of the value + 2, 8) words; the first of the best wins. A word that
    holds white space is as long as its parts and gives way to single words. A document
    is one group, so its words are grouped once and never joined with all windows.
    """
    per = words.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "word", "x0", "x1"))).alias("ws"))
    types = (pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.float64())
    kind = values.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms: dict[str, str] = {}
        for batch in batches:
            found = []
            for value, texts, x0, x1 in zip(*(batch.column(c) for c in ("value", "texts", "x0", "x1")), strict=True):
                if len(forms) > MAX_FORMS:
                    forms.clear()
                words_of = texts.as_py()
                for w in words_of:
                    if w not in forms:
                        forms[w] = fuzzy.matchable(w) or ""
                score, at, n = fuzzy.best_window(value.as_py(), [forms[w] for w in words_of], split=True)
                if at is None or score < cutoff:
                    found.append((score, None, None, None, None))
                else:
                    left, right = (x.values.slice(at, n).to_pylist() for x in (x0, x1))
                    found.append((score, at, n, float(min(left)), float(max(right))))
            if found:
                columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("value"), *columns], names=["doc_id", "value", "score", "pos", "n", "x0", "x1"])

    rows = values.join(per, "doc_id").select("doc_id", "value", F.col("ws.word").alias("texts"), F.col("ws.x0").alias("x0"), F.col("ws.x1").alias("x1"))
    return arrow_pass(rows, run, f"doc_id {kind}, value string, score double, pos int, n int, x0 double, x1 double")


@op("sc_ground", "documents", "words", oracle="""SELECT doc_id, value, 100.0::DOUBLE AS score, CAST(min(pos) AS INT) AS pos FROM (SELECT doc_id, word || ' ' || lead(word) OVER w AS value2, pos FROM {words} WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) g
  JOIN (SELECT doc_id AS d, array_to_string(list_slice(string_split(text, ' '), 3, 4), ' ') AS value FROM {documents} WHERE len(string_split(text, ' ')) >= 6) v ON v.d = g.doc_id AND lower(trim(v.value)) = lower(g.value2)
  WHERE NOT regexp_matches(v.value, '[\\n]') AND NOT contains(v.value, 'ß') GROUP BY ALL""")
def sc_ground(documents, words):
    """Two words of each document are found again where they first stand."""
    words_of = F.split("text", " ")
    value = F.array_join(F.slice(words_of, 3, 2), " ")
    values = documents.where(F.size(words_of) >= 6).select("doc_id", value.alias("value")).where(~F.col("value").contains("\n") & ~F.col("value").contains("ß"))
    return ground(values, words).select("doc_id", "value", "score", "pos").where("pos IS NOT NULL")


@op("sc_fuzzy_ground", "documents", "words")
def sc_fuzzy_ground(documents, words):
    """Misread values (a character dropped) are grounded by similarity."""
    value = F.array_join(F.slice(F.split("text", " "), 5, 3), " ")
    values = documents.select("doc_id", F.substring(value, 2, 200).alias("value"))
    return ground(values, words)


@op("sink_md", "outcomes", oracle="""SELECT '| ' || coalesce(CAST(run AS VARCHAR), 'All') || ' | ' || coalesce(field, 'All') || ' | ' || count(*) FILTER (WHERE status = 'correct') || '/' || count(*) || ' |' AS line
  FROM {outcomes} GROUP BY ROLLUP (run, field)""")
def sink_md(outcomes):
    """The scoreboard as lines of a markdown table (its size is runs times fields, not the input's)."""
    rows = outcomes.rollup("run", "field").agg(F.count_if(F.col("status") == "correct").alias("correct"), F.count(F.lit(1)).alias("n"))
    line = F.format_string("| %s | %s | %d/%d |", F.coalesce(F.col("run").cast("string"), F.lit("All")), F.coalesce("field", F.lit("All")), "correct", "n")
    return rows.select(line.alias("line"))
