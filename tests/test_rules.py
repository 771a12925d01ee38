"""The rule registry on hand-made contexts: pass, fail and not applicable."""

from decimal import Decimal

import pytest

from ledgerlens.operators.messages import MESSAGES
from ledgerlens.operators.rules import registry, rule, run_rules

SCHEMA = (
    "annotation_id int, fields map<string,struct<value:string,source:string,shadow:string>>, numeric_keys array<string>, required_keys array<string>, "
    "lines array<struct<quantity:decimal(18,4),unit_price:decimal(18,4),line_amount:decimal(18,4)>>, page_text string, type_code string, type_name string, "
    "vat_category string, vat_percent decimal(9,2), qr map<int,string>, has_icv boolean, has_pih boolean, has_ubl boolean, pdf_has_arabic boolean"
)
NUMERIC = ["subtotal", "vat_amount", "total_amount"]


def context(n, source="vlm", shadow=None, lines=(), page="", type_code="388", type_name="0100000", category=None, percent=None, qr=None, icv=True, pih=True, ubl=False, arabic=False, required=(), **fields):
    dec = lambda x: None if x is None else Decimal(x)
    return (
        n, {k: (v, source, (shadow or {}).get(k)) for k, v in fields.items()}, NUMERIC, list(required), [tuple(map(dec, line)) for line in lines], page, type_code, type_name,
        category, dec(percent), qr, icv, pih, ubl, arabic,
    )


A, B, C = {"subtotal": "100.00", "vat_amount": "15.00", "total_amount": "115.00"}, "3" * 15, "المشتري " * 30
#: code -> (failing, passing, not applicable) keyword arguments.
CASES = {
    "LINE_TOTAL_MISMATCH": ({**A, "lines": [("2", "40", None), (None, None, "20.02")]}, {**A, "lines": [("2", "40", None), (None, None, "20.01")]}, {**A}),
    "LINE_ITEM_PRICE_MISMATCH": ({"lines": [("2", "40", "80.02")]}, {"lines": [("2", "40", "80.01")]}, {"lines": [("2", None, "1")]}),
    "VAT_CALC_MISMATCH": ({**A, "vat_amount": "15.02"}, {**A, "percent": "15"}, {"subtotal": "1"}),
    "GRAND_TOTAL_MISMATCH": ({**A, "total_amount": "115.02"}, {**A, "total_amount": "115.01"}, {"subtotal": "1", "vat_amount": "x", "total_amount": "1"}),
    "SUBTOTAL_EQUALS_TOTAL": ({"subtotal": "9", "total_amount": "9.00"}, {"subtotal": "9", "total_amount": "9", "vat_amount": "0"}, {"subtotal": "9", "total_amount": "9", "source": "human"}),
    "NEGATIVE_AMOUNT": ({**A, "subtotal": "-1"}, {**A}, {**A, "subtotal": "-1", "type_code": "381"}),
    "TRN_FORMAT": ({"seller_trn": "300987654300004"}, {"seller_trn": "310122393500003"}, {"seller_trn": ""}),
    "TRN_TAX_TYPE_UNEXPECTED": ({"seller_trn": B}, {"seller_trn": "310122393500003"}, {"seller_trn": "12"}),
    "VAT_CATEGORY_VALID": ({"category": "Q"}, {"category": " s "}, {}),
    "VAT_RATE_CONSISTENT": ({"category": "S", "percent": "5"}, {"category": "Z", "percent": "0"}, {"category": "O", "percent": "0"}),
    "INVOICE_TYPE_THRESHOLD": ({"total_amount": "1000.00", "type_name": "0200000"}, {"total_amount": "999.99", "type_name": "0200000"}, {"total_amount": "5000"}),
    "QR_TOTAL_MATCH": ({**A, "qr": {4: "116.00"}}, {**A, "qr": {4: "115.00", 5: "15.01"}}, {**A, "qr": {1: "x"}}),
    "SEQUENCE_FIELDS_PRESENT": ({"ubl": True, "icv": False}, {"ubl": True}, {"ubl": True, "icv": False, "type_name": "0200000"}),
    "XML_PDF_MISMATCH": ({"subtotal": "2.3", "source": "ubl_xml", "shadow": {"subtotal": "2.31"}}, {"subtotal": "2.3", "source": "ubl_xml", "shadow": {"subtotal": "2.30"}}, {**A}),
    "QR_MODEL_MISMATCH": (
        {"vat_amount": "6798.00", "source": "qr", "shadow": {"vat_amount": "6789.00"}},
        {"seller_name": "شركة", "issue_date": "2026-02-10", "source": "qr", "shadow": {"seller_name": "Company", "issue_date": "10/02/2026"}},
        {"vat_amount": "1", "source": "qr"},
    ),
    "OCR_SUBSTRING_MISSING": ({"subtotal": "77.10", "page": "Total 99"}, {"subtotal": "52118.00", "vat_amount": "2.30", "page": "52,118.00 and 2.3"}, {"subtotal": "7", "page": "x", "source": "human"}),
    "ARABIC_ENCODING_SUSPECT": ({"seller_name": "ÙÙØ³Ø", "source": "ubl_xml", "ubl": True, "arabic": True}, {"seller_name": "Acme", "source": "ubl_xml", "ubl": True, "arabic": True}, {"seller_name": "", "source": "ubl_xml", "ubl": True}),
    "TEXT_LAYER_FRAGMENTED": ({"page": "م " * 30}, {"page": C}, {"page": "م " * 19}),
    "REQUIRED_FIELD_MISSING": ({"required": ["b", "a"], "a": " "}, {"required": ["a"], "a": "x"}, {}),
}


@pytest.fixture(scope="module")
def results(spark):
    rows = [context(3 * i + j, **case) for i, cases in enumerate(CASES.values()) for j, case in enumerate(cases)]
    out = {}
    for r in run_rules(spark.createDataFrame(rows, SCHEMA)).collect():
        out.setdefault((r.annotation_id, r.rule_code), []).append(r)
    return out


@pytest.mark.parametrize("code", CASES)
def test_three_values(results, code):
    at = 3 * list(CASES).index(code)
    failed, passed = results[at, code], results[at + 1, code]
    assert not any(r.passed for r in failed) and [r.passed for r in passed] == [True] and (at + 2, code) not in results
    assert passed[0].message_en == MESSAGES[code][2] and passed[0].message_ar == MESSAGES[code][1]
    assert all(r.severity == MESSAGES[code][0] and r.message_en and r.message_ar and "{" not in r.message_en + r.message_ar for r in failed)


def test_messages_carry_values(results):
    codes = list(CASES)
    message = lambda code: results[3 * codes.index(code), code][0].message_en
    assert message("GRAND_TOTAL_MISMATCH") == "Subtotal (100.00) plus VAT (15.00) is 115.00, but the stated total is 115.02."
    assert message("VAT_CALC_MISMATCH") == "VAT at 15% on 100.00 is 15.00, but the invoice states 15.02."
    assert message("LINE_ITEM_PRICE_MISMATCH") == "Line 1: quantity (2) x unit price (40.00) = 80.00, but the line amount is 80.02."
    assert message("VAT_RATE_CONSISTENT") == "VAT category 'S' implies a rate of 15%, but the invoice states 5%."
    assert message("TEXT_LAYER_FRAGMENTED").startswith("100% of the page's Arabic words")
    assert [r.field_key for r in results[3 * codes.index("REQUIRED_FIELD_MISSING"), "REQUIRED_FIELD_MISSING"]] == ["a", "b"]


def test_registry():
    assert set(registry()) == set(MESSAGES) == set(CASES) and len(MESSAGES) == 19
    with pytest.raises(ValueError, match="duplicate"):
        rule("TRN_FORMAT")(lambda: None)
