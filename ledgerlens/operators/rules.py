"""The rule registry: three-valued checks over one wide row per annotation.

A rule is a Column expression over a context row: NULL where it doesn't apply, an
empty array where it passes, else one struct per finding. The runner turns each
into rows (nothing, one passed row, or the findings) with a single ``inline``, so all
rules run in one narrow stage without a shuffle.

Context columns: annotation_id, fields map<string, struct<value, source, shadow>>,
numeric_keys and required_keys array<string>, lines array<struct<quantity,
unit_price, line_amount>>, page_text, type_code, type_name, vat_category, vat_percent,
qr map<int, string>, has_icv, has_pih, has_ubl, pdf_has_arabic.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import scalars as S
from ledgerlens.operators.messages import EMPTY_NAME, MESSAGES, QR_LABELS, SEQUENCE_PARTS

FINDING = "array<struct<field_key:string,message_ar:string,message_en:string>>"
LINE = "array<struct<quantity:decimal(18,4),unit_price:decimal(18,4),line_amount:decimal(18,4)>>"
AMOUNTS = ("subtotal", "vat_amount", "total_amount")

_RULES: dict[str, Callable[[], Column]] = {}


def rule(code: str):
    """Register a rule under its code; a code can be registered once."""

    def add(f: Callable[[], Column]):
        if code in _RULES:
            raise ValueError(f"duplicate rule code: {code}")
        if code not in MESSAGES:
            raise ValueError(f"rule {code} has no messages")
        _RULES[code] = f
        return f

    return add


def registry() -> dict[str, Callable[[], Column]]:
    return dict(_RULES)


def _fill(template: str, values: dict[str, Column]) -> Column:
    """The template with its placeholders replaced by columns."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.coalesce(values[p].cast("string"), F.lit("None")) if i % 2 else F.lit(p) for i, p in enumerate(parts) if p or i % 2])


def _finding(code: str, on: Column | str | None, templates: tuple[str, str] | None = None, /, **values: Column) -> Column:
    ar, en = templates or MESSAGES[code][3:]
    field = F.lit(on) if on is None or isinstance(on, str) else on
    return F.struct(field.cast("string").alias("field_key"), _fill(ar, values).alias("message_ar"), _fill(en, values).alias("message_en"))


def _result(applies: Column, findings: Column) -> Column:
    """NULL unless the rule applies; else the array of findings without nulls."""
    return F.when(F.coalesce(applies, F.lit(False)), F.filter(findings, lambda x: x.isNotNull()).cast(FINDING))


def _one(fails: Column, finding: Column) -> Column:
    return F.array(F.when(F.coalesce(fails, F.lit(False)), finding))


def field(key: str, part: str = "value") -> Column:
    return F.try_element_at("fields", F.lit(key))[part]


def amount(key: str) -> Column:
    return F.col(f"__{key}")


def prepare(ctx: DataFrame) -> DataFrame:
    """The three amounts parsed once, and the match forms that the text rules share."""
    out = ctx.withColumns({f"__{k}": S.to_decimal(field(k)) for k in AMOUNTS})
    return out.withColumn("__haystack", F.coalesce(S.match_form(F.col("page_text")), F.lit(""))).withColumn("__digits", S.digits(F.col("__haystack")))


def same_value(a: Column, b: Column, numeric: Column) -> Column:
    """Equal as decimals where both parse and the field is numeric, else in their match forms."""
    x, y = S.to_decimal(S.canonical(a)), S.to_decimal(S.canonical(b))
    return F.when(a == b, F.lit(True)).when(numeric & x.isNotNull() & y.isNotNull(), x == y).otherwise(S.match_form(a) == S.match_form(b))


@rule("LINE_TOTAL_MISMATCH")
def line_total() -> Column:
    value = lambda x: F.coalesce((x["quantity"] * x["unit_price"]).cast("decimal(38,8)"), x["line_amount"].cast("decimal(38,8)"))
    usable = F.filter(F.transform("lines", value), lambda v: v.isNotNull())
    zero, subtotal = F.lit("0").cast("decimal(38,8)"), amount("subtotal")

    def judge(x: Column) -> Column:
        found = _finding("LINE_TOTAL_MISMATCH", "subtotal", computed=S.money_text(x["total"]), subtotal=S.money_text(subtotal))
        return _result((x["n"] > 0) & subtotal.isNotNull(), _one(~S.close_enough(x["total"], subtotal), found))

    total = lambda u: F.aggregate(u, zero, lambda a, v: (a + v).cast("decimal(38,8)"))
    return S.let(S.let(usable, lambda u: F.struct(F.size(u).alias("n"), total(u).alias("total"))), judge)


@rule("LINE_ITEM_PRICE_MISMATCH")
def line_items() -> Column:
    complete = F.filter(
        F.transform("lines", lambda x, i: F.struct((i + 1).alias("index"), x.alias("line"))),
        lambda y: y["line"]["quantity"].isNotNull() & y["line"]["unit_price"].isNotNull() & y["line"]["line_amount"].isNotNull(),
    )

    def judge(y: Column) -> Column:
        line, expected = y["line"], (y["line"]["quantity"] * y["line"]["unit_price"]).cast("decimal(38,8)")
        # Trailing zeros of a quantity aren't shown.
        quantity = F.regexp_replace(F.regexp_replace(line["quantity"].cast("string"), r"0+$", ""), r"\.$", "")
        found = _finding(
            "LINE_ITEM_PRICE_MISMATCH", None, index=y["index"], quantity=quantity, price=S.money_text(line["unit_price"]),
            expected=S.money_text(expected), amount=S.money_text(line["line_amount"]),
        )
        return F.when(~S.close_enough(expected, line["line_amount"].cast("decimal(38,8)")), found)

    return S.let(complete, lambda c: _result(F.size(c) > 0, F.transform(c, judge)))


@rule("VAT_CALC_MISMATCH")
def vat_rate_applied() -> Column:
    rate = F.coalesce(F.col("vat_percent"), F.lit(S.VAT_STANDARD).cast("decimal(9,2)"))
    subtotal, vat = amount("subtotal"), amount("vat_amount")
    expected = subtotal * (rate * F.lit("0.01").cast("decimal(3,2)"))
    shown = F.regexp_replace(F.regexp_replace(rate.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    found = _finding("VAT_CALC_MISMATCH", "vat_amount", rate=shown, subtotal=S.money_text(subtotal), expected=S.money_text(expected), vat=S.money_text(vat))
    return _result(subtotal.isNotNull() & vat.isNotNull(), _one(~S.close_enough(expected, vat), found))


@rule("GRAND_TOTAL_MISMATCH")
def grand_total() -> Column:
    subtotal, vat, total = map(amount, AMOUNTS)
    found = _finding("GRAND_TOTAL_MISMATCH", "total_amount", subtotal=S.money_text(subtotal), vat=S.money_text(vat), expected=S.money_text(subtotal + vat), total=S.money_text(total))
    return _result(subtotal.isNotNull() & vat.isNotNull() & total.isNotNull(), _one(~S.close_enough(subtotal + vat, total), found))


@rule("SUBTOTAL_EQUALS_TOTAL")
def subtotal_is_total() -> Column:
    subtotal, total = amount("subtotal"), amount("total_amount")
    human = F.coalesce(field("subtotal", "source") == "human", F.lit(False))
    found = _finding("SUBTOTAL_EQUALS_TOTAL", "subtotal", subtotal=S.money_text(subtotal), total=S.money_text(total))
    return _result(subtotal.isNotNull() & total.isNotNull() & ~human, _one(field("vat_amount").isNull() & S.close_enough(subtotal, total), found))


@rule("NEGATIVE_AMOUNT")
def negative() -> Column:
    credit = F.coalesce(F.col("type_code") == "381", F.lit(False))
    each = [F.when(amount(k) < 0, _finding("NEGATIVE_AMOUNT", k, key=F.lit(k), amount=S.money_text(amount(k)))) for k in AMOUNTS]
    return _result(~credit & F.coalesce(*map(amount, AMOUNTS)).isNotNull(), F.array(*each))


def _trns(judge: Callable[[Column], Column]) -> list[Column]:
    return [F.when(F.coalesce(field(k), F.lit("")) != "", judge(field(k))) for k in ("seller_trn", "buyer_trn")]


@rule("TRN_FORMAT")
def trn_format() -> Column:
    keys = ("seller_trn", "buyer_trn")
    given = F.coalesce(*_trns(lambda v: F.lit(True)))
    return _result(given, F.array(*[F.when((field(k) != "") & ~S.trn_valid(field(k)), _finding("TRN_FORMAT", k, value=field(k))) for k in keys]))


@rule("TRN_TAX_TYPE_UNEXPECTED")
def trn_type() -> Column:
    keys = ("seller_trn", "buyer_trn")
    valid = F.coalesce(*[S.trn_type(field(k)) for k in keys]).isNotNull()
    return _result(valid, F.array(*[F.when(S.trn_type(field(k)) != "03", _finding("TRN_TAX_TYPE_UNEXPECTED", k, value=field(k), type=S.trn_type(field(k)))) for k in keys]))


def _category() -> Column:
    return F.upper(F.trim("vat_category"))


@rule("VAT_CATEGORY_VALID")
def vat_category() -> Column:
    return _result(F.col("vat_category").isNotNull(), _one(~_category().isin(*S.VAT_CATEGORIES), _finding("VAT_CATEGORY_VALID", None, category=F.col("vat_category"))))


@rule("VAT_RATE_CONSISTENT")
def vat_rate() -> Column:
    expected = F.when(_category() == "S", F.lit(15)).when(_category().isin("Z", "E"), F.lit(0))
    found = _finding("VAT_RATE_CONSISTENT", None, category=_category(), expected=expected, rate=F.regexp_replace(F.col("vat_percent").cast("string"), r"\.?0+$", ""))
    return _result(expected.isNotNull() & F.col("vat_percent").isNotNull(), _one(F.col("vat_percent") != expected, found))


@rule("INVOICE_TYPE_THRESHOLD")
def simplified_threshold() -> Column:
    total = amount("total_amount")
    return _result(F.col("type_name").startswith("02") & total.isNotNull(), _one(total >= F.lit(S.SIMPLIFIED_FROM).cast("decimal(10,0)"), _finding("INVOICE_TYPE_THRESHOLD", "total_amount", total=S.money_text(total))))


@rule("QR_TOTAL_MATCH")
def qr_totals() -> Column:
    each, applies = [], []
    for tag, key in ((4, "total_amount"), (5, "vat_amount")):
        encoded, extracted = S.to_decimal(F.try_element_at("qr", F.lit(tag))), amount(key)
        label_ar, label_en = (F.lit(x) for x in QR_LABELS[key])
        both = encoded.isNotNull() & extracted.isNotNull()
        applies.append(F.coalesce(both, F.lit(False)))
        found = _finding("QR_TOTAL_MATCH", key, label_ar=label_ar, label_en=label_en, encoded=S.money_text(encoded), extracted=S.money_text(extracted))
        each.append(F.when(both & ~S.close_enough(encoded, extracted), found))
    return _result(applies[0] | applies[1], F.array(*each))


@rule("SEQUENCE_FIELDS_PRESENT")
def sequence_fields() -> Column:
    missing = lambda i, sep: F.array_join(F.array(*[F.when(~F.col(f"has_{k}"), F.lit(v[i])) for k, v in SEQUENCE_PARTS.items()]), sep)
    found = _finding("SEQUENCE_FIELDS_PRESENT", None, missing_ar=missing(0, "، "), missing_en=missing(1, ", "))
    return _result(F.col("has_ubl") & F.col("type_name").startswith("01"), _one(~(F.col("has_icv") & F.col("has_pih")), found))


def _compared(source: str) -> Column:
    """(key, entry) of the fields from ``source`` that have a value and a model's shadow value, by key."""
    entries = F.array_sort(F.map_entries("fields"))
    return F.filter(entries, lambda e: (e["value"]["source"] == source) & e["value"]["value"].isNotNull() & e["value"]["shadow"].isNotNull())


@rule("XML_PDF_MISMATCH")
def xml_and_model() -> Column:
    def judge(e: Column) -> Column:
        key, value, shadow = e["key"], e["value"]["value"], e["value"]["shadow"]
        return F.when(~same_value(value, shadow, F.array_contains("numeric_keys", key)), _finding("XML_PDF_MISMATCH", key, key=key, value=value, shadow=shadow))

    return S.let(_compared("ubl_xml"), lambda c: _result(F.size(c) > 0, F.transform(c, judge)))


@rule("QR_MODEL_MISMATCH")
def qr_and_model() -> Column:
    def judge(e: Column) -> Column:
        key, value, shadow = e["key"], e["value"]["value"], e["value"]["shadow"]
        dates = F.coalesce(S.to_date(value) == S.to_date(shadow), F.lit(False))
        text = (S.has_arabic(value) != S.has_arabic(shadow)) | same_value(value, shadow, F.array_contains("numeric_keys", key))
        return F.when(~F.when(key == "issue_date", dates).otherwise(text), _finding("QR_MODEL_MISMATCH", key, key=key, value=value, shadow=shadow))

    return S.let(_compared("qr"), lambda c: _result(F.size(c) > 0, F.transform(c, judge)))


@rule("OCR_SUBSTRING_MISSING")
def printed_on_page() -> Column:
    hay, hay_digits = F.col("__haystack"), F.col("__digits")

    def needle(key: Column) -> Column:
        entry = F.try_element_at("fields", key)
        exempt = F.coalesce(entry["source"].isin("ubl_xml", "human", "computed", "qr"), F.lit(True))
        return F.struct(key.alias("key"), entry["value"].alias("value"), F.when(~exempt, F.nullif(S.match_form(entry["value"]), F.lit(""))).alias("own"))

    needles = F.filter(F.transform(F.array_sort("numeric_keys"), needle), lambda x: x["own"].isNotNull())

    def printed(own: Column) -> Column:
        # Cheap tests first: the text, its digits; the page's numbers are parsed only for what is left.
        number = S.to_decimal(own)
        same_number = F.coalesce(number.isNotNull() & F.array_contains(S.numbers_in(hay), number), F.lit(False))
        return F.when(hay.contains(own), True).when((S.digits(own) != "") & hay_digits.contains(S.digits(own)), True).otherwise(same_number)

    def judge(x: Column) -> Column:
        return F.when(~printed(x["own"]), _finding("OCR_SUBSTRING_MISSING", x["key"], value=x["value"], key=x["key"]))

    has_text = F.trim(F.coalesce("page_text", F.lit(""))) != ""
    return S.let(needles, lambda n: _result(has_text & (F.size(n) > 0), F.transform(n, judge)))


@rule("ARABIC_ENCODING_SUSPECT")
def arabic_encoding() -> Column:
    each, given = [], []
    for key in ("seller_name", "buyer_name"):
        signed = F.coalesce(field(key, "source") == "ubl_xml", F.lit(False))
        value = F.coalesce(field(key), F.lit(""))
        given.append(signed)
        broken = _finding("ARABIC_ENCODING_SUSPECT", key, key=F.lit(key), value=F.substring(value, 1, 40))
        empty = _finding("ARABIC_ENCODING_SUSPECT", key, EMPTY_NAME, key=F.lit(key))
        each.append(F.when(signed & (F.trim(value) == ""), empty).when(signed & S.mojibake(value), broken))
    return _result(F.col("has_ubl") & F.col("pdf_has_arabic") & (given[0] | given[1]), F.array(*each))


@rule("TEXT_LAYER_FRAGMENTED")
def fragmented() -> Column:
    def judge(r: Column) -> Column:
        percent = F.concat(F.bround(r["single"] * 100, 0).cast("int").cast("string"), F.lit("%"))
        return _result(r.isNotNull(), _one((r["single"] >= 0.25) & (r["article"] < 0.05), _finding("TEXT_LAYER_FRAGMENTED", None, single=percent)))

    return S.let(S.fragment_ratios(F.col("page_text")), judge)


@rule("REQUIRED_FIELD_MISSING")
def required_fields() -> Column:
    blank = lambda k: F.trim(F.coalesce(F.try_element_at("fields", k)["value"], F.lit(""))) == ""
    return _result(F.size("required_keys") > 0, F.transform(F.filter(F.array_sort("required_keys"), blank), lambda k: _finding("REQUIRED_FIELD_MISSING", k, key=k)))


OUTCOME = "array<struct<rule_code:string,severity:string,passed:boolean,field_key:string,message_ar:string,message_en:string>>"


def _rows(code: str) -> Column:
    """A rule's result rows: none where it doesn't apply, one passed row, or its findings."""
    severity, ar, en, _, _ = MESSAGES[code]
    summary = F.array(F.struct(F.lit(None).cast("string").alias("field_key"), F.lit(ar).alias("message_ar"), F.lit(en).alias("message_en"))).cast(FINDING)

    def rows(found: Column) -> Column:
        passed = F.size(found) == 0
        row = lambda x: F.struct(
            F.lit(code).alias("rule_code"), F.lit(severity).alias("severity"), passed.alias("passed"),
            x["field_key"].alias("field_key"), x["message_ar"].alias("message_ar"), x["message_en"].alias("message_en"),
        )
        return F.transform(F.when(passed, summary).otherwise(found), row)

    return F.coalesce(S.let(_RULES[code](), rows), F.array().cast(OUTCOME))


def run_rules(ctx: DataFrame, codes: list[str] | None = None) -> DataFrame:
    """annotation_id, rule_code, severity, passed, field_key, message_ar, message_en."""
    outcomes = [_rows(code) for code in codes or list(_RULES)]
    every = F.concat(*outcomes) if len(outcomes) > 1 else outcomes[0]
    return prepare(ctx).select("annotation_id", F.inline(every))
