"""Sinks: JSON, guarded CSV, plain XLSX, markdown, and keyed upserts."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.functions import scalars as S
from ledgerlens.session import arrow_pass

BOM = "﻿"


def json_text(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """key, body: each row's columns as JSON, nulls kept and non-ASCII as it is."""
    return df.select(key, F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("body"))


def csv_cell(c: Column) -> Column:
    """One CSV cell: guarded against formulas, quoted where it must be; null is empty."""
    guarded = S.csv_guard(c)
    quoted = F.concat(F.lit('"'), F.replace(guarded, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(guarded.rlike(r'[",\r\n]'), quoted).otherwise(guarded), F.lit(""))


def csv_lines(df: DataFrame, columns: list[str], texts: set[str]) -> DataFrame:
    """Rows as CSV lines in the column ``line``; only text columns are guarded."""
    cells = [csv_cell(F.col(c)) if c in texts else F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return df.withColumn("line", F.concat_ws(",", *cells))


def write_csv(df: DataFrame, path: str, columns: list[str], order: list[str]) -> None:
    """One CSV file with a byte-order mark and CRLF, written row by row on the driver (an export of a few invoices)."""
    texts = {n for n, t in df.dtypes if t == "string"}
    rows = csv_lines(df.orderBy(*order), columns, texts).select("line")
    with open(path, "w", encoding="utf-8", newline="") as out:
        out.write(BOM + ",".join(columns) + "\r\n")
        for r in rows.toLocalIterator():
            out.write(r["line"] + "\r\n")


_SHEET = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'


def _cell(value) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, int | float) or type(value).__name__ == "Decimal":
        return f"<c><v>{value}</v></c>"
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


def _write_workbook(target, sheets: dict[str, tuple[list[str], Iterable]]) -> None:
    main = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
        n = len(sheets)
        z.writestr("[Content_Types].xml", '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, n + 1)) + "</Types>")
        z.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{main}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{main}"><sheets>' + "".join(f'<sheet name="{escape(name)}" sheetId="{i}" r:id="rId{i}"/>' for i, name in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{main}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, n + 1)) + "</Relationships>")
        for i, (columns, rows) in enumerate(sheets.values(), 1):
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as out:
                out.write((_SHEET + "<row>" + "".join(map(_cell, columns)) + "</row>").encode())
                for r in rows:
                    out.write(("<row>" + "".join(map(_cell, r)) + "</row>").encode())
                out.write(b"</sheetData></worksheet>")


def write_xlsx(path: str, sheets: dict[str, DataFrame]) -> None:
    """A workbook with a sheet per frame: text cells typed as text (never a formula), numbers as numbers."""
    _write_workbook(path, {name: (df.columns, df.toLocalIterator()) for name, df in sheets.items()})


def workbooks(rows: DataFrame, key: str, sheet: str, order: str, columns: list[str]) -> DataFrame:
    """``key``, content: a workbook per key, made where its rows are; ``sheet`` names each row's sheet."""
    kind = rows.schema[key].dataType.simpleString()

    def book(own: list[tuple]) -> bytes:
        sheets: dict[str, tuple[list[str], list]] = {}
        for name, cells in own:
            sheets.setdefault(name, (columns, []))[1].append(cells)
        target = io.BytesIO()
        _write_workbook(target, sheets)
        return target.getvalue()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last = None
        keys, done = [], []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(done, pa.binary())], names=[key, "content"])
            keys.clear()
            done.clear()
            return out

        for batch in batches:
            for own, name, *cells in zip(*(batch.column(c).to_pylist() for c in (key, sheet, *columns)), strict=True):
                if held and own != last:
                    keys.append(last)
                    done.append(book(held))
                    held = []
                held.append((name, cells))
                last = own
            if done:
                yield flush()
        if held:
            keys.append(last)
            done.append(book(held))
            yield flush()

    dealt = rows.select(key, sheet, order, *columns).repartition(key).sortWithinPartitions(key, order)
    return arrow_pass(dealt, run, f"{key} {kind}, content binary")


def workbook_cells(books: DataFrame, key: str) -> DataFrame:
    """``key``, sheet, row (0: the names), column, value of every filled cell of workbooks."""
    kind = books.schema[key].dataType.simpleString()
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"

    def cells_of(own, content: bytes) -> Iterator[tuple]:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{ns}sheet")]
            for i, name in enumerate(names, 1):
                for row, cells in enumerate(ElementTree.fromstring(z.read(f"xl/worksheets/sheet{i}.xml")).iter(f"{ns}row")):
                    yield from ((own, name, row, at, "".join(c.itertext())) for at, c in enumerate(cells) if len(c))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [c for own, content in zip(*(batch.column(c).to_pylist() for c in (key, "content")), strict=True) for c in cells_of(own, content)]
            if found:
                own, *rest = zip(*found, strict=True)
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(own, batch.column(key).type), *(pa.array(c, t) for c, t in zip(rest, kinds, strict=True))], names=[key, "sheet", "row", "column", "value"])

    return arrow_pass(books.select(key, "content"), run, f"{key} {kind}, sheet string, row int, column int, value string")


def upsert(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows, replaced by fresh ones of the same key (nulls in keys are equal), plus the new ones."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(fresh.withColumn("__new", F.lit(1)))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("__new")))
    return both.withColumn("__n", rank).where("__n = 1").drop("__n", "__new")


def write_markdown(df: DataFrame, path: str) -> None:
    """An aggregate as a markdown table, row by row."""
    with open(path, "w", encoding="utf-8") as out:
        out.write("| " + " | ".join(df.columns) + " |\n|" + " --- |" * len(df.columns) + "\n")
        for r in df.toLocalIterator():
            out.write("| " + " | ".join("" if v is None else str(v) for v in r) + " |\n")
