"""Decoders of structured documents: UBL invoice XML, TLV QR payloads, JSON lines, ground truth, delimited text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.functions import scalars as S
from ledgerlens.session import arrow_pass
from ledgerlens.sources.pdf import MalformedPdf, embedded_xml

_PARTY = "struct<Party:struct<PartyLegalEntity:struct<RegistrationName:string>,PartyTaxScheme:struct<CompanyID:string>,PostalAddress:struct<StreetName:string,BuildingNumber:string,CityName:string,PostalZone:string,Country:struct<IdentificationCode:string>>>>"
#: The parts of a UBL invoice that are read; names are matched without their prefix.
UBL_SCHEMA = (
    "struct<ID:string,UUID:string,IssueDate:string,IssueTime:string,InvoiceTypeCode:struct<_VALUE:string,_name:string>,DocumentCurrencyCode:string,"
    "AdditionalDocumentReference:array<struct<ID:string,UUID:string,Attachment:struct<EmbeddedDocumentBinaryObject:string>>>,"
    f"AccountingSupplierParty:{_PARTY},AccountingCustomerParty:{_PARTY},"
    "TaxTotal:array<struct<TaxAmount:string,TaxSubtotal:array<struct<TaxableAmount:string,TaxAmount:string,TaxCategory:struct<ID:string,Percent:string>>>>>,"
    "LegalMonetaryTotal:struct<LineExtensionAmount:string,TaxExclusiveAmount:string,TaxInclusiveAmount:string,PayableAmount:string>,"
    "InvoiceLine:array<struct<ID:string,InvoicedQuantity:string,LineExtensionAmount:string,Item:struct<Name:string>,Price:struct<PriceAmount:string>>>,"
    "_corrupt_record:string>"
)


def parse_ubl(xml: Column) -> Column:
    """The invoice struct; null for malformed XML or a document with a DOCTYPE (entities are never read)."""
    safe = F.when(~xml.rlike(r"(?i)<!DOCTYPE"), xml)
    parsed = F.from_xml(safe, UBL_SCHEMA, {"ignoreNamespace": "true", "rowTag": "Invoice"})
    return S.let(parsed, lambda p: F.when(p["_corrupt_record"].isNull(), p))


def ubl_fields(df: DataFrame, xml: str = "xml") -> DataFrame:
    """The frame with typed invoice columns: id, issue_date, names, TRNs, amounts, first tax subtotal, lines, ICV and PIH."""
    u = F.col("__u")
    trn = lambda p: u[p]["Party"]["PartyTaxScheme"]["CompanyID"]
    name = lambda p: u[p]["Party"]["PartyLegalEntity"]["RegistrationName"]
    money = lambda c: S.to_decimal(c).cast("decimal(18,4)")
    refs, tax = u["AdditionalDocumentReference"], F.get(u["TaxTotal"], F.lit(0))
    first = F.get(tax["TaxSubtotal"], F.lit(0))
    line = lambda x: F.struct(money(x["InvoicedQuantity"]).alias("quantity"), money(x["Price"]["PriceAmount"]).alias("unit_price"), money(x["LineExtensionAmount"]).alias("line_amount"), x["Item"]["Name"].alias("name"))
    has = lambda code: F.coalesce(F.exists(refs, lambda r: r["ID"] == code), F.lit(False))
    return df.withColumn("__u", parse_ubl(F.col(xml))).select(
        *df.columns, u.isNotNull().alias("well_formed"), u["ID"].alias("invoice_number"), S.iso_date(u["IssueDate"]).alias("issue_date"), S.ubl_time(u["IssueTime"]).alias("issue_time"),
        u["InvoiceTypeCode"]["_VALUE"].alias("type_code"), u["InvoiceTypeCode"]["_name"].alias("type_name"), u["DocumentCurrencyCode"].alias("currency"),
        name("AccountingSupplierParty").alias("seller_name"), trn("AccountingSupplierParty").alias("seller_trn"), name("AccountingCustomerParty").alias("buyer_name"), trn("AccountingCustomerParty").alias("buyer_trn"),
        money(u["LegalMonetaryTotal"]["TaxExclusiveAmount"]).alias("subtotal"), money(tax["TaxAmount"]).alias("vat_amount"), money(u["LegalMonetaryTotal"]["TaxInclusiveAmount"]).alias("total_amount"),
        first["TaxCategory"]["ID"].alias("vat_category"), money(first["TaxCategory"]["Percent"]).alias("vat_percent"), F.transform(u["InvoiceLine"], line).alias("lines"),
        has("ICV").alias("has_icv"), has("PIH").alias("has_pih"),
    )


_BASE64 = r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"
_ITEMS = "array<struct<tag:int,value:string>>"


def decode_tlv(payload: Column) -> Column:
    """array<struct<tag, value>> of a base64 tag-length-value payload (values in hex); null if it isn't one.

    A fold over the bytes: every entry takes two bytes at least, so half as many
    steps as there are bytes reach the end. Truncated entries make it null.
    """
    text = F.trim(payload)
    return S.let(F.hex(F.when(text.rlike(_BASE64) & (text != ""), F.unbase64(text))), _fold_tlv)


def _fold_tlv(data: Column) -> Column:
    """The entries of a payload given in hex."""
    size = (F.length(data) / 2).cast("int")
    start = F.struct(F.lit(0).alias("at"), F.lit(True).alias("ok"), F.array().cast(_ITEMS).alias("items"))

    def byte(at: Column) -> Column:
        return F.conv(F.substring(data, at * 2 + 1, F.lit(2)), 16, 10).cast("int")

    def step(s: Column, _: Column) -> Column:
        length = byte(s["at"] + 1)
        end = s["at"] + 2 + length
        item = F.struct(byte(s["at"]).alias("tag"), F.substring(data, s["at"] * 2 + 5, length * 2).alias("value"))
        good = F.coalesce(end <= size, F.lit(False))
        moved = F.struct(F.when(good, end).otherwise(s["at"]).alias("at"), good.alias("ok"), F.when(good, F.concat(s["items"], F.array(item))).otherwise(s["items"]).alias("items"))
        return F.when(~s["ok"] | (s["at"] >= size), s).otherwise(moved)

    steps = F.sequence(F.lit(0), F.greatest(size / 2, F.lit(1)).cast("int"))
    return S.let(F.aggregate(steps, start, step), lambda end: F.when(data.isNotNull() & end["ok"] & (end["at"] == size), end["items"]))


def tlv_text(items: Column, tag: int) -> Column:
    """The text of a tag; the last of repeated tags counts."""
    own = F.filter(items, lambda x: x["tag"] == tag)
    return F.decode(F.unhex(F.get(own, F.size(own) - 1)["value"]), "UTF-8")


def qr_payload(payload: Column) -> Column:
    """struct of a complete QR (five texts that aren't blank, both amounts numbers), else null."""
    names = ("seller_name", "seller_trn", "timestamp", "total", "vat")
    texts = S.let(decode_tlv(payload), lambda items: F.struct(*[tlv_text(items, i).alias(n) for i, n in enumerate(names, 1)]))
    return S.let(texts, _complete_qr)


def _complete_qr(t: Column) -> Column:
    text = {n: t[n] for n in ("seller_name", "seller_trn", "timestamp", "total", "vat")}
    complete = F.lit(True)
    for c in text.values():
        complete = complete & (F.trim(F.coalesce(c, F.lit(""))) != "")
    complete = complete & S.to_decimal(text["total"]).isNotNull() & S.to_decimal(text["vat"]).isNotNull()
    fields = F.struct(*[c.alias(n) for n, c in text.items()], S.qr_date(text["timestamp"]).alias("issue_date"))
    return F.when(complete, fields)


def parse_jsonl(lines: DataFrame, schema: str, by: str = "line_no", value: str = "value") -> DataFrame:
    """One JSON object per line; a missing id becomes doc_%04d by line number; blank lines go."""
    parsed = lines.where(F.trim(value) != "").withColumn("__r", F.from_json(value, schema, {"mode": "PERMISSIVE"}))
    default = F.format_string("doc_%04d", F.col(by).cast("long"))
    return parsed.select(F.coalesce(F.col("__r.id"), default).alias("doc_key"), F.col("__r").alias("record"))


def read_ground_truth(df: DataFrame, json: str = "json") -> DataFrame:
    """document_id, field_key, expected of {document_id, fields: {...}} texts; the last text of a document replaces earlier ones."""
    parsed = df.select("seq", F.from_json(json, "document_id string, fields map<string,string>").alias("r")).select("seq", "r.*").where("document_id IS NOT NULL")
    last = parsed.withColumn("n", F.row_number().over(W.partitionBy("document_id").orderBy(F.desc("seq")))).where("n = 1")
    return last.select("document_id", F.explode("fields").alias("field_key", "expected"))


def pdf_attachments(files: DataFrame) -> DataFrame:
    """path, xml, malformed of PDFs read by the ``binaryFile`` source (xml null without an attachment, malformed for what is no PDF)."""

    def found(content: bytes | None) -> tuple[str | None, bool]:
        try:
            xml = embedded_xml(content or b"")
        except MalformedPdf:
            return None, True
        return (xml.decode("utf-8", "replace") if xml else None), False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                xml, malformed = zip(*(found(c.as_py()) for c in part.column("content")), strict=True)
                yield pa.RecordBatch.from_arrays([part.column("path"), pa.array(xml, pa.string()), pa.array(malformed)], names=["path", "xml", "malformed"])

    return arrow_pass(files.select("path", "content"), run, "path string, xml string, malformed boolean")
