"""Findings about pages whose text couldn't be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The degraded sources of a page's text, their codes and their bilingual messages.
FINDINGS = {
    "ocr_unsupported_script": (
        "OCR_SCRIPT_UNSUPPORTED",
        "الصفحة {page}: لا تحتوي على طبقة نصية، ولم يتعرّف المحرك على أي نص. محرك التعرّف الضوئي الحالي لا يدعم اللغة العربية، لذلك لا يمكن تمييز الصفحة العربية الممسوحة ضوئياً عن الصفحة الفارغة.",
        "No text layer, and OCR recognised nothing. The configured OCR engine cannot read Arabic, so an image-only Arabic page produces this same result as a blank one. This page could not be processed.",
    ),
    "ocr_unavailable": ("OCR_ENGINE_UNAVAILABLE", "الصفحة {page}: محرك التعرّف الضوئي غير متاح.", "No text layer, and the OCR engine was unavailable."),
    "empty": ("PAGE_TEXT_EMPTY", "الصفحة {page}: لم يُعثر على أي نص.", "No text layer and OCR recognised nothing on this page."),
}
UNREADABLE = "ocr_unsupported_script"


def page_findings(pages: DataFrame, missing_required: DataFrame) -> DataFrame:
    """document_id, page, rule_code, severity, message_ar, message_en: one finding per degraded page.

    ``pages``: document_id, page, source. ``missing_required``: the document_ids that lack a required field.
    A finding is an error only on a page in an unreadable script, where no page of the document is usable
    or a required field is missing; else it is a warning.
    """
    degraded = F.col("source").isin(*FINDINGS)
    usable = F.bool_or(~degraded).over(W.partitionBy("document_id"))
    lacking = missing_required.select("document_id").distinct().withColumn("lacks", F.lit(True))
    bad = pages.withColumn("usable", usable).where(degraded).join(lacking, "document_id", "left")
    blocking = (F.col("source") == UNREADABLE) & (~F.col("usable") | F.coalesce("lacks", F.lit(False)))

    def of(part: int) -> Column:
        return F.coalesce(*[F.when(F.col("source") == s, F.lit(v[part])) for s, v in FINDINGS.items()])

    page = F.col("page").cast("string")
    return bad.select(
        "document_id", "page", of(0).alias("rule_code"), F.when(blocking, "error").otherwise("warning").alias("severity"),
        F.replace(of(1), F.lit("{page}"), page).alias("message_ar"), F.concat(of(2), F.lit(" (page "), page, F.lit(")")).alias("message_en"),
    )
