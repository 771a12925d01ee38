"""Hand-made cases of the scalar functions, and parity with Python's decimals."""

from decimal import ROUND_HALF_EVEN, Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlens.functions import fuzzy
from ledgerlens.functions import scalars as S


def one(spark, rows, schema, column):
    """The column's value for each row, in order."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"__i int, {schema}")
    return [r.v for r in df.select("__i", column.alias("v")).orderBy("__i").collect()]


def each(spark, f, cases):
    assert one(spark, [(k,) for k in cases], "c string", f(F.col("c"))) == list(cases.values())


def test_numerals_and_dates(spark):
    each(spark, S.numerals, {"٠١٢٣٤٥٦٧٨٩": "0123456789", "۰۹": "09", None: None})
    day = __import__("datetime").date
    each(spark, S.to_date, {"2026-02-10T11:35:00Z": day(2026, 2, 10), "10/02/2026": day(2026, 2, 10), "10.2.2026": day(2026, 2, 10), "٢٠٢٦-٠٢-١٠": day(2026, 2, 10), "2024-02-30": None, "soon": None})
    assert one(spark, [("6/11/2022",), ("14/09/2022",), ("3 Sept 22",), ("March 5th, 2021",), ("none",)], "c string", F.size(S.date_readings(F.col("c")))) == [2, 1, 1, 1, 0]


def test_trn(spark):
    each(spark, S.trn_valid, {"310122393500003": True, "3101-2239 3500003": True, "300987654300004": False, "31012239350000": False, "": False})
    each(spark, S.trn_type, {"310122393500003": "03", "311111111110013": "13", "x": None})


def test_money(spark):
    each(spark, lambda c: S.money_text(S.to_decimal(c)), {"0.125": "0.12", "0.135": "0.14", "1,234.565": "1234.56", "٫5": "0.50", "1٬000٫5": "1000.50", "": None, "SAR": None})
    each(spark, S.format_money, {"1234567.89": "1,234,567.89", "-1234": "-1,234", "999": "999", "n/a": "n/a", "": "—", None: "—"})


@settings(max_examples=20, deadline=None)
@given(st.lists(st.decimals(min_value=-(10**9), max_value=10**9, places=4), min_size=1, max_size=30))
def test_money_is_half_even(spark, values):
    got = one(spark, [(str(v),) for v in values], "c string", S.money(S.to_decimal(F.col("c"))))
    assert [Decimal(g) for g in got] == [v.quantize(Decimal("0.01"), ROUND_HALF_EVEN) for v in values]


def test_guards_and_keys(spark):
    each(spark, S.csv_guard, {"=1+1": "'=1+1", "+SUM(A1)": "'+SUM(A1)", "@cmd": "'@cmd", "-1+1": "'-1+1", "-150.00": "-150.00", "-45,320.00": "-45,320.00", "": "", "-": "'-", "-1.": "'-1.", "-1.2.3": "'-1.2.3", "-,5": "'-,5", "\tx": "'\tx", "+1": "'+1"})
    each(spark, S.storage_key_ok, {"org/1/page-1.webp": True, "a/../b": False, "/etc/x": False, "a b": False, None: False})
    each(spark, S.safe_filename, {"../../x.pdf": "x.pdf", "C:\\a\\b.pdf": "b.pdf", "a\u0007b": "ab", "dir/": None})


LABELS = [
    ("المشتري: x", "المشتري"), ("ا لمشتر ي", "المشتري"), ("BUYER: x", "Buyer"), ("المشتريات", None), ("المشترين", None), ("", None),
]


def test_labels(spark):
    got = one(spark, [(t,) for t, _ in LABELS], "c string", S.label_present(F.array(F.lit("Buyer"), F.lit("المشتري")), F.col("c")))
    assert got == [want for _, want in LABELS]
    assert one(spark, [("PO 7",)], "c string", S.label_present(F.array(F.lit("PO")), F.col("c"))) == [None]


def test_json_values(spark):
    each(spark, S.coerce_json, {'" a "': "a", "12": "12", "1.5": "1.5", "true": "true", "null": None, '"N/A"': None, "[1]": None, '{"a":1}': None})
    each(spark, S.json_reply, {'{"a":1}': '{"a":1}', '```json\n{"a":1}\n```': '{"a":1}', "[1]": None, "text": None})


@pytest.mark.parametrize("text, want", [("ﻣﻜﺔ", "مكة"), ("a\u00a0–\u200bb", "a -b"), ("١٢", "12"), ("مُحَمَّد", "محمد"), ("ـــا", "ا"), ("SA\u00ad2026", "SA-2026")])
def test_canonical(text, want):
    assert fuzzy.canonical(text) == want


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=127), max_size=30))
def test_plain_text_is_folded_like_any_other(text):
    # A mark that folds away takes the general way.
    assert fuzzy.canonical(text) == fuzzy.canonical(text + "\u200b")
    assert fuzzy.matchable(text) == fuzzy.matchable(text + "\u200b")


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=30))
def test_canonical_is_idempotent(text):
    once = fuzzy.canonical(text)
    assert fuzzy.canonical(once) == once


ODD = "aAéÉßİıſﬁ½№ﷲﻣﻜﺔأإآاىيةه\u0654\u064e\u0301\u0323ـ١۹٪\u200b\u00ad–\u00a0\t\n 　Ａ１ｶﾞ𝐀Σσςǅŉ"


@settings(max_examples=25, deadline=None)
@given(st.lists(st.one_of(st.text(ODD, max_size=12), st.text(max_size=12)), min_size=1, max_size=60))
def test_forms_in_the_jvm_are_the_definition(spark, texts):
    texts = [t for t in texts if "\0" not in t and not any(0xD800 <= ord(c) < 0xE000 for c in t)] + [None, "e\u0323\u0301", "\u1112\u1161\u11ab"]
    assert one(spark, [(t,) for t in texts], "c string", S.canonical(F.col("c"))) == [fuzzy.canonical(t) for t in texts]
    assert one(spark, [(t,) for t in texts], "c string", S.match_form(F.col("c"))) == [fuzzy.matchable(t) for t in texts]


def test_amounts(spark):
    cases = {"LE 3,754.00": "3754.00", "153.51 EGP": "153.51", "*299.00": "299.00", "1,234,567.5": "1234567.50", "12,5": "12.00", "1,23,456": "1.00", "-42.5": "-42.50", "٣٬٧٥٤٫٥": "3754.50", "1.2.3": "1.20", "none": None, "": None, None: None, "a -b 7": "7.00", "5.": "5.00"}
    each(spark, lambda c: S.money_text(S.parse_amount(c)), cases)


def test_date_readings(spark):
    d = __import__("datetime").date
    cases = {
        "2022-11-06": [d(2022, 11, 6)], "06/11/2022": [d(2022, 6, 11), d(2022, 11, 6)], "14/09/2022": [d(2022, 9, 14)], "at 14.09.22 10:30": [d(2022, 9, 14)], "3 Sept 22": [d(2022, 9, 3)],
        "5Mar2021": [d(2021, 3, 5)], "March 5th, 2021": [d(2021, 3, 5)], "mar. 5, 21": [d(2021, 3, 5)], "March 2021": [], "2024-02-30": [], "12 items 2020": [], "12345/11/2022": [], "1/2/345": [],
        "٢٠٢٢/١١/٠٦": [d(2022, 11, 6)], "12 foo 2020, mar 5, 2021": [d(2021, 3, 5)], "none": [], "": [], "March 5 th, 2021": [], "due 5 - MAY - 2021": [d(2021, 5, 5)],
    }
    each(spark, S.date_readings, cases)


def test_numbers_questions_and_buckets(spark):
    each(spark, lambda c: F.array_join(F.transform(S.numbers_in(c), S.money_text), " "), {"1,234.50 and 7 or 1.25,3.50": "1234.50 7.00 1.25 3.50", "no": ""})
    asked = {"What is the store name?": "seller_name", "what is the NAME of the pharmacy": "seller_name", "What is the name of the company?": None, "What is the order number?": None, "When was the purchase made?": "issue_date"}
    asked |= {"What was the grand total?": "total_amount", "what is the total due": None, "What is the VAT?": "vat_amount", "what is the total before tax": "subtotal", "What is the tax number": "seller_trn", "what is the bill no": "invoice_number", None: None}
    each(spark, S.field_for, asked)
    got = one(spark, [(x,) for x in (0.0, 0.05, 0.1, 0.12, 0.29, 0.3, 0.99, 1.0, 7.0, None)], "c double", S.bucket(F.col("c")))
    assert got == ["<0.05", "<0.10", "<0.15", "<0.15", "<0.30", "<0.50", "<1.00", ">=1.00", ">=1.00", None]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abcé ", max_size=20), st.text("abcé ", max_size=20))
def test_indel_ratio(a, b):
    assert fuzzy.indel_ratio(a, b) == (200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0)


def test_token_set():
    assert fuzzy.token_set_ratio("gourmet", "gourmet food stores") == 100
    assert fuzzy.token_set_ratio("gourmet food", "hyper one") < 85 and fuzzy.token_set_ratio("", "x") == 0
    assert fuzzy.matchable("سلمى الأنصاري") == fuzzy.matchable("سلمي الانصاري")
