"""Reading order of printed words: segmentation, columns, direction, runs and wraps as window operators.

Words (or glyphs) carry their place in the stream (``ord``) and a box; ``group`` names the
columns of the page, line or fragment that an operator works inside. What a script's letters
are is a parameter with Arabic and Hebrew as the default, so that a test or a query may let
other letters play their part. Lengths are in the boxes' own units; both axes may differ by a
page's ``width`` and ``height``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Letters that never join the next one, and the measures of gaps.
NON_JOINING = "اأإآدذرزو"
GAP, NON_JOINING_GAP = 0.5, 1.1
COLUMN_GAP, WRAP_BELOW, WRAP_WITHIN = 0.5, 0.5, 1.0
#: A letter of a script that is written from right to left, and one of any other.
RTL_LETTER = r"[\p{IsArabic}\p{IsHebrew}\p{IsSyriac}\p{IsThaana}\p{IsNko}&&\p{L}]"
LTR_LETTER = r"[\p{L}&&[^\p{IsArabic}\p{IsHebrew}\p{IsSyriac}\p{IsThaana}\p{IsNko}]]"

Test = Callable[[Column], Column]


def is_rtl(word: Column) -> Column:
    return word.rlike(RTL_LETTER)


def is_ltr(word: Column) -> Column:
    """A word with a letter that isn't right-to-left; digits alone don't count."""
    return word.rlike(LTR_LETTER)


def has_letter(word: Column) -> Column:
    return word.rlike(r"\p{L}")


def ends_non_joining(word: Column) -> Column:
    return F.right(word, F.lit(1)).isin(*NON_JOINING)


def islands(df: DataFrame, group: list[str], order: list, starts: Column, name: str = "island") -> DataFrame:
    """Number the runs that ``starts`` begins, from 0."""
    w = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.when(F.coalesce(starts, F.lit(False)), 1).otherwise(0)).over(w))


def segment(glyphs: DataFrame, group: list[str], text: str = "word", order: str = "ord", non_joining: Test = ends_non_joining) -> DataFrame:
    """Group, island and the joined text of the words that glyphs make.

    A space always breaks. Else a gap does that is wider than a factor of the mean width of the
    glyphs on either side (of those that have one), and the factor is larger after a letter that never joins.
    """
    w = W.partitionBy(*group).orderBy(order)
    own = F.col("x1") - F.col("x0")
    before, last = F.lag("x1").over(w), F.lag(text).over(w)
    previous = F.lag(own).over(w)
    wide = lambda c: F.when(c > 0, c)
    scale = F.coalesce((wide(own) + wide(previous)) / F.lit(2.0), wide(own), wide(previous), F.lit(1.0))
    factor = F.when(non_joining(last), F.lit(NON_JOINING_GAP)).otherwise(F.lit(GAP))
    # A space breaks on both sides: it is an island of its own that goes in the end.
    blank = lambda c: F.trim(F.regexp_replace(c, r"(?U)\s", "")) == ""
    starts = blank(F.col(text)) | blank(last) | (F.col("x0") - before > factor * scale)
    words = islands(glyphs, group, [order], starts).where(~blank(F.col(text)))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text])
    joined = words.groupBy(*group, "island").agg(F.array_join(parts, "").alias(text), F.min(order).alias("__at"))
    # Numbered anew, as the spaces' islands are gone.
    place = F.row_number().over(W.partitionBy(*group).orderBy("__at")) - 1
    return joined.select(*group, place.cast("long").alias("island"), text)


def split_columns(words: DataFrame, group: list[str], text: str = "word", order: str = "ord", width: float = 1.0, height: float = 1.0, rtl: Test = is_rtl) -> DataFrame:
    """The words with the column segment (``island``) of their fragment, in the order of the segments' first words.

    A fragment with a right-to-left word is cut where a word begins further than half a line's height
    beyond the furthest right edge so far; any other stays whole.
    """
    fragment = W.partitionBy(*group)
    visual = fragment.orderBy("x0", "x1", order)
    line = F.max(F.col("y1") - F.col("y0")).over(fragment) * F.lit(height)
    reach = F.max("x1").over(visual.rowsBetween(W.unboundedPreceding, -1))
    measured = words.withColumns({"__cuts": F.bool_or(rtl(F.col(text))).over(fragment), "__line": line, "__reach": reach})
    starts = F.col("__cuts") & ((F.col("x0") - F.col("__reach")) * F.lit(width) > COLUMN_GAP * F.col("__line"))
    cut = islands(measured, group, ["x0", "x1", order], starts, "__segment")
    first = F.min(order).over(W.partitionBy(*group, "__segment"))
    numbered = cut.withColumn("__first", first)
    return numbered.withColumn("island", F.dense_rank().over(fragment.orderBy("__first")) - 1).drop("__cuts", "__line", "__reach", "__segment", "__first")


def page_direction(words: DataFrame, page: list[str], text: str = "word", rtl: Test = is_rtl, ltr: Test = is_ltr) -> DataFrame:
    """Whether a page has more right-to-left words than words with other letters."""
    own = F.col(text)
    return words.groupBy(*page).agg((F.count_if(rtl(own)) > F.count_if(ltr(own))).alias("rtl"))


def reading_order(words: DataFrame, row: list[str], page_rtl: Column, text: str = "word", order: str = "ord", rtl: Test = is_rtl, letter: Test = has_letter) -> DataFrame:
    """The words with their ``place`` in their row, from 1.

    A row without a right-to-left word keeps the stream's order. In any other, words in visual order form
    runs of one direction; a word without a letter between two right-to-left ones goes with them. A right-to-left run is
    read from the right, any other in the stream's order, and on a right-to-left page the runs from the right.
    """
    visual = W.partitionBy(*row).orderBy("x0", "x1", order)
    own = F.col(text)
    marked = words.withColumns({"__rtl": rtl(own), "__any": F.bool_or(rtl(own)).over(W.partitionBy(*row))})
    between = ~letter(own) & F.coalesce(F.lag("__rtl").over(visual) & F.lead("__rtl").over(visual), F.lit(False))
    settled = marked.withColumn("__kind", F.col("__rtl") | between).withColumn("__page", page_rtl)
    runs = islands(settled, row, ["x0", "x1", order], ~F.col("__kind").eqNullSafe(F.lag("__kind").over(visual)), "__run")
    seen = runs.withColumn("__seen", F.row_number().over(visual))
    at = F.when(F.col("__any"), F.when(F.col("__page"), -F.col("__run")).otherwise(F.col("__run")))
    inside = F.when(F.col("__any") & F.col("__kind"), -F.col("__seen")).otherwise(F.col(order))
    place = F.row_number().over(W.partitionBy(*row).orderBy(at, inside))
    return seen.withColumn("place", place).drop("__rtl", "__any", "__kind", "__page", "__run", "__seen")


def join_wrapped(words: DataFrame, page: list[str], text: str = "word", order: str = "ord", height: float = 1.0, hyphen: str = "-") -> DataFrame:
    """Each page's words as one text: a space between them, but none where a value wrapped.

    A word wraps that ends in a hyphen after a letter or digit, if the next begins with one, is no
    label (no colon at its end) and sits directly below: half a line lower at least, and not more
    than a line below its bottom.
    """
    w = W.partitionBy(*page).orderBy(order)
    own, last = F.col(text), F.lag(text).over(w)
    line = (F.lag("y1").over(w) - F.lag("y0").over(w)) * F.lit(height)
    solid = lambda c: c.rlike(r"^[\p{L}\p{N}]$")
    broken = last.endswith(hyphen) & (F.length(last) >= 2) & solid(F.left(F.right(last, F.lit(2)), F.lit(1)))
    goes_on = solid(F.left(own, F.lit(1))) & ~own.endswith(":")
    below = (F.col("y0") - F.lag("y0").over(w)) * F.lit(height) >= WRAP_BELOW * line
    close = (F.col("y0") - F.lag("y1").over(w)) * F.lit(height) <= WRAP_WITHIN * line
    glued = F.coalesce(broken & goes_on & (line > 0) & below & close, F.lit(False))
    parts = words.select(*page, order, F.concat(F.when(last.isNull() | glued, "").otherwise(" "), own).alias("__part"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "__part"))), lambda x: x["__part"]), "")
    return parts.groupBy(*page).agg(joined.alias("text"))


#: Words that a window may have beyond those of the value it is compared with, and in all.
MORE_WORDS, MOST_WORDS = 2, 8


def windows(words: DataFrame, page: list[str], value_words: int, text: str = "word", order: str = "ord") -> DataFrame:
    """All windows of consecutive words that a value of ``value_words`` words is compared with: page, pos, n, gram."""
    most = min(value_words + MORE_WORDS, MOST_WORDS)
    per = words.groupBy(*page).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]).alias("ws"))
    sizes = per.select(*page, "ws", F.explode(F.sequence(F.lit(1), F.least(F.lit(most), F.size("ws")))).alias("n"))
    starts = sizes.select(*page, "ws", "n", F.explode(F.sequence(F.lit(0), F.size("ws") - F.col("n"))).alias("pos"))
    return starts.select(*page, "pos", "n", F.array_join(F.slice("ws", F.col("pos") + 1, F.col("n")), " ").alias("gram"))
