"""Reading order with sequential state: consecutive fragments fused into rows, page by page."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Share of a line's height by which fragments must overlap, and the widest gap between them.
OVERLAP, ROW_GAP = 0.5, 0.5


class RowFuser:
    """Row numbers of fragments in stream order, page after page.

    A fragment joins the row before it if one of both is right-to-left, they overlap
    vertically by half a line and the gap between them is half a line at most. The
    row's box grows as it goes, so this can't be a window function; the state is one box.
    """

    def __init__(self) -> None:
        self.page, self.number, self.box, self.rtl = None, -1, None, False

    def row(self, page: int, rtl: bool, x0: float, y0: float, x1: float, y1: float) -> int:
        if page != self.page:
            self.page, self.number, self.box, self.rtl = page, -1, None, False
        box, joins = self.box, False
        if box is not None and (self.rtl or rtl):
            overlap, height = min(box[3], y1) - max(box[1], y0), min(box[3] - box[1], y1 - y0)
            gap = max(0.0, max(box[0], x0) - min(box[2], x1))
            joins = height > 0 and overlap >= OVERLAP * height and gap <= ROW_GAP * height
        if joins:
            self.box, self.rtl = (min(box[0], x0), min(box[1], y0), max(box[2], x1), max(box[3], y1)), self.rtl or rtl
        else:
            self.number, self.box, self.rtl = self.number + 1, (x0, y0, x1, y1), rtl
        return self.number


def fuse_page(page: pd.DataFrame) -> pd.DataFrame:
    """doc_id, ord, row of fragments (doc_id, ord, rtl, x0, y0, x1, y1)."""
    return next(_fuse(iter([page.sort_values(["doc_id", "ord"])])))


def _fuse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    fuser = RowFuser()
    for b in batches:
        columns = (b[c].tolist() for c in ("doc_id", "rtl", "x0", "y0", "x1", "y1"))
        rows = [fuser.row(*r) for r in zip(*columns, strict=True)]
        yield b[["doc_id", "ord"]].assign(row=pd.Series(rows, index=b.index, dtype="int32"))


def fuse_rows(fragments: DataFrame) -> DataFrame:
    """doc_id, ord, row: pages dealt by id and streamed in order, many to a batch."""
    return fragments.repartition("doc_id").sortWithinPartitions("doc_id", "ord").select("doc_id", "ord", "rtl", "x0", "y0", "x1", "y1").mapInPandas(_fuse, "doc_id long, ord int, row int")
