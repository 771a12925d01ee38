"""Reading order on real Arabic: hand-made lines whose right order is known."""

from pyspark.sql import functions as F

from ledgerlens.operators import reading


def line(spark, *words, height=10):
    """Words of one line: (text, x0, x1) in stream order, or (text, x0, x1, y0)."""
    rows = [(1, 1, i, w[0], float(w[1]), float(w[2]), float(w[3] if len(w) > 3 else 0), float((w[3] if len(w) > 3 else 0) + height)) for i, w in enumerate(words)]
    return spark.createDataFrame(rows, "page int, line int, ord int, word string, x0 double, x1 double, y0 double, y1 double")


def segments(spark, glyphs):
    rows = reading.segment(line(spark, *glyphs), ["page", "line"]).orderBy("island").collect()
    assert [r.island for r in rows] == list(range(len(rows)))
    return [r.word for r in rows]


def test_segments(spark):
    # Widths of ten: a gap over five parts a word, over eleven after a letter that never joins.
    assert segments(spark, [("ب", 0, 10), ("ي", 15, 25), ("ت", 31, 41)]) == ["بي", "ت"]
    assert segments(spark, [("د", 0, 10), ("ا", 20, 30), ("ر", 42, 52)]) == ["دا", "ر"]
    assert segments(spark, [("a", 0, 10), (" ", 10, 11), ("b", 11, 21), ("\u00a0", 21, 22), (" ", 22, 23), ("c", 23, 33)]) == ["a", "b", "c"]
    assert segments(spark, [("a", 0, 0), ("b", 0.9, 0.9), ("c", 2, 2)]) == ["a", "b", "c"]  # without widths one unit counts
    assert segments(spark, [(" ", 0, 5)]) == []


def placed(spark, words, rtl):
    rows = reading.reading_order(line(spark, *words), ["page", "line"], F.lit(rtl)).orderBy("place").collect()
    return [r.word for r in rows]


SELLER = [("البائع", 90, 100), ("شركة", 70, 80), ("النور", 50, 60)]


def test_runs(spark):
    assert placed(spark, SELLER[::-1], True) == ["البائع", "شركة", "النور"]
    # Between two Arabic words a number goes with them, anywhere else it stays with the left-to-right side.
    assert placed(spark, [("رقم", 90, 100), ("12", 70, 80), ("شارع", 50, 60)], True) == ["رقم", "12", "شارع"]
    assert placed(spark, [("2026", 10, 20), ("-", 22, 24), ("09", 26, 30), ("التاريخ", 90, 100)], True) == ["التاريخ", "2026", "-", "09"]
    # On a left-to-right page the label comes first, and a line without Arabic keeps the stream's order.
    assert placed(spark, [("Seller:", 0, 10), ("النور", 20, 30), ("شركة", 40, 50)], False) == ["Seller:", "شركة", "النور"]
    assert placed(spark, [("b", 20, 30), ("a", 0, 10)], True) == ["b", "a"]


def test_page_direction(spark):
    rtl = lambda *words: reading.page_direction(line(spark, *[(w, 0, 1) for w in words]), ["page"]).first().rtl
    assert rtl("فاتورة", "12", "34") and not rtl("فاتورة", "Invoice") and not rtl("12") and rtl("שלום")


def test_columns(spark):
    cut = lambda *words: [r.island for r in reading.split_columns(line(spark, *words), ["page", "line"]).orderBy("ord").collect()]
    # Half a line's height is five; segments are numbered by their first word in the stream.
    assert cut(("الكمية", 50, 60), ("سعر", 20, 30), ("الوحدة", 33, 44)) == [0, 1, 1]
    assert cut(("سعر", 20, 30), ("الوحدة", 35, 44), ("طويل", 10, 40)) == [0, 0, 0]
    assert cut(("Quantity", 50, 60), ("price", 20, 30)) == [0, 0]


def test_wraps(spark):
    join = lambda *words: reading.join_wrapped(line(spark, *words), ["page"]).first().text
    assert join(("INV-", 0, 10, 0), ("2026", 0, 10, 12)) == "INV-2026"
    assert join(("INV-", 0, 10, 0), ("2026", 0, 10, 0)) == "INV- 2026"  # beside it, not below
    assert join(("INV-", 0, 10, 0), ("2026", 0, 10, 25)) == "INV- 2026"  # a paragraph further
    assert join(("-", 0, 10, 0), ("2026", 0, 10, 12)) == "- 2026" and join((".-", 0, 10, 0), ("a", 0, 10, 12)) == ".- a"
    assert join(("INV-", 0, 10, 0), ("Total:", 0, 10, 12)) == "INV- Total:" and join(("INV-", 0, 10, 0), ("(a", 0, 10, 12)) == "INV- (a"
    assert join(("رقم-", 0, 10, 0), ("٢٠٢٦", 0, 10, 12)) == "رقم-٢٠٢٦"


def test_windows(spark):
    words = line(spark, *[(c, 0, 1) for c in "abcdefghij"])
    sizes = lambda n: sorted({r.n for r in reading.windows(words, ["page"], n).collect()})
    assert sizes(1) == [1, 2, 3] and sizes(4) == list(range(1, 7)) and sizes(9) == list(range(1, 9))
    got = {(r.pos, r.n): r.gram for r in reading.windows(words, ["page"], 9).collect()}
    assert len(got) == sum(11 - n for n in range(1, 9)) and got[2, 8] == "c d e f g h i j"
