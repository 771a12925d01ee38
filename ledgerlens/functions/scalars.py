"""Scalar functions over text columns, as Catalyst expressions only."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions.folding import ALEF, ALEF_FAMILY, ALEF_MAKSURA, ARABIC_DIGITS, ASCII_DIGITS, HEH, TA_MARBUTA, YEH, canonical, match_form, match_text

# The ranges of Arabic letters and shaped glyphs, and what tells words of it apart.
ARABIC = r"[\u0600-\u06FF\uFB50-\uFDFF\uFE70-\uFEFF]"
PRESENTATION = r"[\uFB50-\uFDFF\uFE70-\uFEFF]"
DEFINITE_ARTICLE = "ال"
PLURAL_ENDINGS = ("ات", "ون", "ين", "ان")
#: Fixed value: a number as a page prints it, with thousands separators and a fraction, Arabic ones included.
PRINTED_NUMBER = r"\d[\d,٬]*(?:[.٫]\d+)?"
#: Money and tax constants.
CENT, VAT_STANDARD, SIMPLIFIED_FROM = "0.01", "15", "1000"
VAT_CATEGORIES = ("S", "Z", "E", "O")
TRN = "^3[0-9]{13}3$"

MONEY = "decimal(38,10)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def numerals(c: Column) -> Column:
    """Arabic-Indic and Eastern Arabic-Indic digits as ASCII digits."""
    return F.translate(c, ARABIC_DIGITS, ASCII_DIGITS)


def has_arabic(c: Column) -> Column:
    return c.rlike(ARABIC)


def has_presentation_forms(c: Column) -> Column:
    return c.rlike(PRESENTATION)


def fold_orthography(c: Column) -> Column:
    """Letters that everyday writing interchanges, on one of them."""
    return F.translate(c, ALEF_FAMILY + ALEF_MAKSURA + TA_MARBUTA, ALEF * 3 + YEH + HEH)


def squash(c: Column) -> Column:
    """Without any white space, Unicode's included."""
    return F.regexp_replace(c, r"(?U)\s+", "")


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def to_decimal(c: Column) -> Column:
    """Money text: separators dropped, Arabic ones folded; null where it is no number."""
    text = F.regexp_replace(F.translate(F.trim(c), "٫,٬", "."), r"^$", "x")
    return text.try_cast(MONEY)


def money(c: Column) -> Column:
    """Two decimals, half to even."""
    return F.bround(c, 2)


def close_enough(a: Column, b: Column) -> Column:
    """Within a cent after each side is rounded."""
    return F.abs(money(a) - money(b)) <= F.lit(CENT).cast("decimal(3,2)")


def money_text(c: Column) -> Column:
    return money(c).cast("decimal(38,2)").cast("string")


def iso_date(c: Column) -> Column:
    return F.try_to_date(c, "yyyy-M-d")


def to_date(c: Column) -> Column:
    """The first ISO date in the text, else the first day-first date; null if unreal."""
    folded = numerals(c)
    iso = F.regexp_extract(folded, r"(\d{4}-\d{1,2}-\d{1,2})", 1)
    day_first = F.regexp_replace(F.regexp_extract(folded, r"(\d{1,2}[/.\-]\d{1,2}[/.\-]\d{4})", 1), r"[/.]", "-")
    return F.when(iso != "", iso_date(iso)).when(day_first != "", F.try_to_date(day_first, "d-M-yyyy"))


def ubl_time(c: Column) -> Column:
    """hh:mm[:ss] without a trailing Z, or null."""
    bare = F.regexp_replace(F.trim(c), "Z$", "")
    return F.when(bare.rlike(r"^([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d+)?)?([+-]\d\d:\d\d)?$"), bare)


def trn_digits(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), "[ -]", "")


def trn_valid(c: Column) -> Column:
    return F.coalesce(trn_digits(c).rlike(TRN), F.lit(False))


def trn_type(c: Column) -> Column:
    return F.when(trn_valid(c), F.right(trn_digits(c), F.lit(2)))


def qr_date(c: Column) -> Column:
    """The leading date of a QR timestamp, unchecked; null without one."""
    return F.nullif(F.regexp_extract(c, r"^\s*(\d{4}-\d{2}-\d{2})", 1), F.lit(""))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def numbers_in(c: Column) -> Column:
    """The distinct numbers printed in a text."""
    found = F.regexp_extract_all(c, F.lit(PRINTED_NUMBER), 0)
    return F.array_distinct(F.filter(F.transform(found, to_decimal), lambda x: x.isNotNull()))


def mojibake(c: Column) -> Column:
    """Replacement characters, or a Latin-1 share of a third (two at least) and no Arabic."""
    odd = F.length(F.regexp_replace(c, r"[^\u0080-\u024F]", ""))
    return c.contains("\ufffd") | (~has_arabic(c) & (odd >= F.greatest(F.lit(2), F.floor(F.length(c) / 3))))


def arabic_tokens(c: Column) -> Column:
    return F.filter(F.split(F.trim(c), r"\s+"), has_arabic)


def fragment_ratios(c: Column) -> Column:
    """struct<single, article> shares of the Arabic tokens; null under 20 of them."""

    def shares(tokens: Column) -> Column:
        n = F.size(tokens)
        single = F.size(F.filter(tokens, lambda t: F.length(t) == 1)) / n
        article = F.size(F.filter(tokens, lambda t: t.startswith(DEFINITE_ARTICLE))) / n
        return F.when(n >= 20, F.struct(single.alias("single"), article.alias("article")))

    return let(arabic_tokens(c), shares)


def fragmented(c: Column) -> Column:
    return F.coalesce(let(fragment_ratios(c), lambda r: (r["single"] >= 0.25) & (r["article"] < 0.05)), F.lit(False))


def label_present(labels: Column, text: Column) -> Column:
    """The first label (in the array's order) that the text has, not as part of a plural.

    ``text`` and labels are compared in their match forms without white space.
    """
    fold = lambda c: squash(match_form(c))
    haystack = fold(text)
    endings = "|".join(map(match_text, PLURAL_ENDINGS))

    def present(label: Column) -> Column:
        needle = fold(label)
        quoted = F.regexp_replace(needle, r"([^\p{L}\p{N}])", r"\\$1")
        look = F.when(needle.endswith(YEH), F.lit(f"(?!{endings}|ن)")).otherwise(F.lit(f"(?!{endings})"))
        return (F.length(needle) >= 4) & F.regexp_like(haystack, F.concat(quoted, look))

    return F.get(F.filter(labels, present), F.lit(0))


def search_labels(label_en: Column, label_ar: Column, synonyms: Column) -> Column:
    """Labels to look for: as given, Arabic without its leading 'name' word, English before a bracket, synonyms."""
    shown = [label_en, label_ar, F.regexp_replace(label_ar, "^اسم ", ""), F.regexp_extract(label_en, r"^([^(]*)", 1)]
    every = F.concat(F.array(*[F.trim(x) for x in shown]), F.coalesce(F.transform(synonyms, lambda x: F.trim(x)), F.array().cast("array<string>")))
    return F.array_distinct(F.filter(every, lambda x: x.isNotNull() & (x != "")))


def looks_xml(name: Column, head: Column) -> Column:
    """An .xml name, or content that begins like XML (after a byte-order mark)."""
    return F.lower(name).endswith(".xml") | F.regexp_replace(head, r"^\uFEFF?\s*", "").rlike(r"^<(\?xml|[A-Za-z_][\w.-]*:?Invoice)")


def is_pdf(head: Column) -> Column:
    return F.substring(head, 1, 1024).contains("%PDF-")


def safe_filename(c: Column) -> Column:
    """The last path part without control characters, 255 characters at most; null if nothing is left."""
    last = F.regexp_extract(c, r"([^/\\]*)$", 1)
    return F.nullif(F.substring(F.trim(F.regexp_replace(last, r"[\x00-\x1f\x7f]", "")), 1, 255), F.lit(""))


def storage_key_ok(c: Column) -> Column:
    """Segments of safe characters, relative, without a parent step."""
    return F.coalesce(c.rlike(r"^[A-Za-z0-9][A-Za-z0-9._/-]*$") & ~c.rlike(r"(^|/)\.\.(/|$)"), F.lit(False))


def only(c: Column, characters: str) -> Column:
    """True for a text of these characters alone, one at least."""
    return (F.length(c) > 0) & (F.translate(c, characters, "") == "")


def csv_guard(c: Column) -> Column:
    """A quote before text that a spreadsheet would run as a formula; negative numbers stay.

    A number's sign is followed by a whole part of digits and commas that begins with a
    digit, and by a point and digits or by nothing.
    """
    digits_ = "0123456789"
    parts = F.split(F.substr(c, F.lit(2)), "[.]")
    whole, fraction = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    number = only(F.left(whole, F.lit(1)), digits_) & only(whole, digits_ + ",") & (F.size(parts) <= 2) & F.coalesce(only(fraction, digits_), F.lit(True))
    formula = F.left(c, F.lit(1)).isin("=", "+", "-", "@", "\t", "\r") & ~(c.startswith("-") & number)
    return F.when(formula, F.concat(F.lit("'"), c)).otherwise(c)


def export_cell(kind: Column, c: Column) -> Column:
    """A decimal field's value with two decimals, half to even; other values as they are."""
    number = F.translate(c, ",", "").try_cast(MONEY)
    return F.when((kind == "decimal") & number.isNotNull(), money_text(number)).otherwise(c)


def format_money(c: Column) -> Column:
    """Thousands grouped by text alone; no number: as it is; blank: a dash."""
    whole = F.regexp_replace(F.regexp_extract(c, r"^(-?\d+)", 1), r"(?<=\d)(?=(\d{3})+$)", ",")
    grouped = F.concat(whole, F.regexp_extract(c, r"^-?\d+(\.\d+)?$", 1))
    return F.when(c.isNull() | (c == ""), F.lit("—")).when(c.rlike(r"^-?\d+(\.\d+)?$"), grouped).otherwise(c)


def format_elapsed(seconds: Column) -> Column:
    """m:ss"""
    return F.format_string("%d:%02d", F.floor(seconds / 60).cast("long"), F.pmod(seconds.cast("long"), F.lit(60)))


def format_bytes(n: Column) -> Column:
    return (
        F.when(n < 1024, F.format_string("%d B", n.cast("long")))
        .when(n < 1024 * 1024, F.format_string("%d KB", F.floor(n / 1024 + 0.5).cast("long")))
        .otherwise(F.concat(F.bround(n / (1024.0 * 1024.0), 1).cast("decimal(18,1)").cast("string"), F.lit(" MB")))
    )


def initials(name: Column) -> Column:
    """First letters of the first and the last word, upper-case."""
    words = F.filter(F.split(F.trim(name), r"\s+"), lambda w: w != "")
    first = F.substring(F.get(words, F.lit(0)), 1, 1)
    last = F.when(F.size(words) > 1, F.substring(F.element_at(words, -1), 1, 1)).otherwise(F.lit(""))
    return F.upper(F.concat(first, last))


def interpolate(template: Column, values: dict[str, Column]) -> Column:
    """Replace each known {key}; unknown ones stay."""
    return reduce(lambda t, kv: F.replace(t, F.lit("{" + kv[0] + "}"), kv[1].cast("string")), values.items(), template)


def label_for(own: Column, other: Column, key: Column) -> Column:
    """A field's label: own language, else the other, else the key made readable."""
    words = F.replace(key, F.lit("_"), F.lit(" "))
    readable = F.concat(F.upper(F.substring(words, 1, 1)), F.substr(words, F.lit(2)))
    return F.coalesce(F.nullif(own, F.lit("")), F.nullif(other, F.lit("")), readable)


def numeric_like(kind: Column, value: Column) -> Column:
    return F.coalesce(kind.isin("decimal", "number", "date", "integer"), F.lit(False)) | F.coalesce(
        value.rlike(r"[0-9]") & ~value.rlike(r"[^\x00-\x7F]"), F.lit(False)
    )


def parse_amount(c: Column) -> Column:
    """The first number of a printed amount; grouping commas go, a decimal comma ends it.

    From the first digit on, digits, points and commas are read as groups between commas. A
    group belongs to the number as long as it has exactly three digits before its point or end.
    """
    return F.when(c.rlike(r"^-?[0-9]+([.][0-9]+)?$"), c.try_cast(MONEY)).otherwise(_read_amount(c))


def _read_amount(c: Column) -> Column:
    text = F.translate(canonical(c), "٫٬", ".")
    lead = F.regexp_extract(text, r"^[^0-9]*", 0)
    groups = F.split(F.regexp_extract(text, r"[0-9][0-9.,]*", 0), ",")
    start = F.struct(F.get(groups, F.lit(0)).alias("text"), F.lit(True).alias("open"))

    def grow(s: Column, group: Column) -> Column:
        joins = s["open"] & (F.length(F.substring_index(group, ".", 1)) == 3)
        return F.struct(F.when(joins, F.concat(s["text"], group)).otherwise(s["text"]).alias("text"), joins.alias("open"))

    def number(s: Column) -> Column:
        whole, fraction = F.split_part(s["text"], F.lit("."), F.lit(1)), F.split_part(s["text"], F.lit("."), F.lit(2))
        sign = F.when(lead.endswith("-"), "-").otherwise("")
        return F.concat(sign, whole, F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise("")).try_cast(MONEY)

    return F.when(F.length(lead) < F.length(text), let(F.aggregate(F.slice(groups, 2, F.size(groups)), start, grow), number))


# Month names and their short forms.
MONTHS = (
    "jan january", "feb february", "mar march", "apr april", "may", "jun june",
    "jul july", "aug august", "sep sept september", "oct october", "nov november", "dec december",
)


ORDINALS = ("st", "nd", "rd", "th")
DATE_MARKS = ("-", "/", ".")


def date_readings(c: Column) -> Column:
    """Every date a text could mean, as array<date>: day before month and month before day both where both are real.

    The text is read as items, runs of digits or letters, each with the gap before it. The first
    items in a row that have the shape of a date decide: year, month, day; else day and month in either
    order, year; else day, month name, year; else month name, day, year. A name that is no
    month leaves its shape without a date.
    """
    iso = F.filter(F.array(F.try_to_date(c, "yyyy-M-d")), lambda d: d.isNotNull())
    return F.when(c.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), iso).otherwise(_read_dates(c))


def _read_dates(c: Column) -> Column:
    text = F.lower(canonical(c))
    gaps, runs = (F.regexp_extract_all(text, F.lit("([^0-9a-z]*)([0-9]+|[a-z]+)"), i) for i in (1, 2))
    month_of = F.create_map(*[F.lit(x) for i, names in enumerate(MONTHS, 1) for name in names.split() for x in (name, i)])

    def item(gap: Column, run: Column) -> Column:
        """A run with its length as a number or as a word, and what its gap allows."""
        numeric, n = run.rlike("^[0-9]"), F.length(run)
        bare = F.translate(gap, " \t\n\x0b\f\r", "")
        of = lambda marks: F.translate(bare, marks, "") == ""
        return F.struct(
            run.alias("run"), F.when(numeric, n).alias("number"), F.when(~numeric, n).alias("word"), gap.isin(*DATE_MARKS).alias("marked"),
            of("-/.").alias("to_name"), of("-/.,").alias("from_name"), of(".").alias("to_day"), (of(",") & (gap != "")).alias("to_year"), ((gap == "") & run.isin(*ORDINALS)).alias("ordinal"),
        )

    def readings(items: Column) -> Column:
        at = lambda i, k: F.get(items, i + k) if k else F.get(items, i)
        year_size = lambda x: x["number"].isin(2, 4)
        kept = lambda dates: F.filter(dates, lambda d: d.isNotNull())

        def first(shape: Callable[[Column], Column], then: Callable[[Column], Column]) -> Column:
            places = F.sequence(F.lit(0), F.greatest(F.size(items) - 1, F.lit(0)))
            found = F.get(F.filter(places, lambda i: F.coalesce(shape(i), F.lit(False))), F.lit(0))
            return let(found, lambda i: F.when(i.isNotNull(), then(i)))

        def real(y: Column, m: Column, d: Column) -> Column:
            year = F.when(y["number"] == 2, F.concat(F.lit("20"), y["run"])).otherwise(y["run"])
            return F.try_to_date(F.concat_ws("-", year, m, d["run"]), "yyyy-M-d")

        def named(name: Column, day: Column, year: Column) -> Column:
            month = F.try_element_at(month_of, F.right(name["run"], F.lit(9))).cast("string")
            return F.when(month.isNotNull(), kept(F.array(real(year, month, day))))

        def numbers(i: Column) -> list[Column]:
            return [at(i, k) for k in range(3)]

        def year_first(i: Column) -> Column:
            y, m, d = numbers(i)
            return (y["number"] == 4) & (m["number"] <= 2) & (d["number"] <= 2) & m["marked"] & d["marked"]

        def year_last(i: Column) -> Column:
            a, b, y = numbers(i)
            return (a["number"] <= 2) & (b["number"] <= 2) & year_size(y) & b["marked"] & y["marked"]

        def day_name(i: Column) -> Column:
            d, m, y = numbers(i)
            return (d["number"] <= 2) & m["word"].between(3, 9) & year_size(y) & m["to_name"] & y["from_name"]

        def name_day(i: Column) -> Column:
            m, d, y = numbers(i)
            later = at(i, 3)
            plain, ordinal = year_size(y) & y["to_year"], y["ordinal"] & year_size(later) & later["to_year"]
            return (m["word"] >= 3) & (d["number"] <= 2) & d["to_day"] & (F.coalesce(plain, F.lit(False)) | ordinal)

        return F.coalesce(
            first(year_first, lambda i: kept(F.array(real(at(i, 0), at(i, 1)["run"], at(i, 2))))),
            first(year_last, lambda i: kept(F.array(real(at(i, 2), at(i, 1)["run"], at(i, 0)), real(at(i, 2), at(i, 0)["run"], at(i, 1))))),
            first(day_name, lambda i: named(at(i, 1), at(i, 0), at(i, 2))),
            first(name_day, lambda i: named(at(i, 0), at(i, 1), F.when(at(i, 2)["ordinal"], at(i, 3)).otherwise(at(i, 2)))),
        )

    found = let(F.zip_with(gaps, runs, item), readings)
    return F.coalesce(F.array_sort(F.array_distinct(found)), F.array().cast("array<date>"))


def eval_code(c: Column) -> Column:
    """Only 0-9 and a-z, lower-cased."""
    return F.regexp_replace(F.lower(canonical(c)), "[^0-9a-z]", "")


def eval_name(folded: Column) -> Column:
    """Word characters of an already folded text, single spaces."""
    return collapse(F.regexp_replace(folded, r"(?U)[^\w\s]", " "))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.levenshtein(a, b) / longest)


def question_norm(c: Column) -> Column:
    return collapse(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", " "))


# What a question about a field may say, normalized; lookalikes are left out on purpose.
PLACES = "store shop restaurant supermarket pharmacy merchant".split()
DATED = "transaction receipt purchase invoice order".split()
QUESTIONS: dict[str, list[str]] = {
    "seller_name": [f"what is the name of the {x}" for x in PLACES] + [f"what is the {x} name" for x in PLACES],
    "issue_date": ["what is the date", "what is the date on the receipt"]
    + [f"what is the date of the {x}" for x in DATED]
    + [f"what is the {x} date" for x in ("transaction", "receipt", "invoice", "purchase")]
    + [f"what date was the {x}{made}" for x in ("transaction", "receipt", "purchase") for made in ("", " made")]
    + [f"when was the {x}{made}" for x in ("transaction", "purchase") for made in ("", " made")],
    "invoice_number": [f"what is the {x} {y}" for x in ("transaction", "receipt", "invoice", "bill") for y in ("number", "no")],
    "subtotal": [f"what {v} the {x}" for v in ("is", "was") for x in ("subtotal", "sub total", "subtotal amount")]
    + [f"what is the {x}" for x in ("total amount without vat", "total without vat", "total before vat", "amount before vat", "total excluding vat", "total before tax")],
    "vat_amount": [f"what {v} the {x}" for v in ("is", "was") for x in ("vat amount", "vat value", "total vat", "tax amount", "vat", "amount of vat", "total tax", "tax")],
    "total_amount": [f"what {v} the {x}" for v in ("is", "was") for x in ("total", "total amount", "grand total", "total amount paid", "total price")],
    "seller_trn": [f"what is the {x}" for x in ("vat number", "vat registration number", "tax registration number", "tax number", "vat no")],
}


def field_for(question: Column) -> Column:
    """The field that a question asks for, by its whole normalized text; null for any other."""
    asked = F.create_map(*[F.lit(x) for field, texts in QUESTIONS.items() for text in texts for x in (text, field)])
    return F.try_element_at(asked, question_norm(question))


#: Upper edges of the gap buckets; what lies beyond is a bucket too.
GAP_EDGES = (0.05, 0.10, 0.15, 0.20, 0.30, 0.50, 1.00)


def bucket(c: Column, edges: tuple[float, ...] = GAP_EDGES) -> Column:
    """The first edge above the value as ``<0.05``, or the last as ``>=1.00``."""
    below = F.coalesce(*[F.when(c < e, F.lit(f"<{e:.2f}")) for e in edges], F.lit(f">={edges[-1]:.2f}"))
    return F.when(c.isNotNull(), below)


def bbox_union(words: Column) -> Column:
    """The smallest box around an array of boxes."""
    edge = lambda name, pick: pick(F.transform(words, lambda w: w[name])).alias(name)
    return F.struct(edge("x0", F.array_min), edge("y0", F.array_min), edge("x1", F.array_max), edge("y1", F.array_max))


def coerce_json(c: Column) -> Column:
    """A JSON value as field text: blank and null words give null, booleans true / false, lists and objects null."""
    value = F.try_parse_json(c)
    kind = F.schema_of_variant(value)
    text = F.trim(F.try_variant_get(value, "$", "string"))
    null_word = F.lower(text).isin("", "null", "none", "n/a", "na", "-")
    return F.when(kind.startswith("ARRAY") | kind.startswith("OBJECT") | kind.startswith("STRUCT"), F.lit(None).cast("string")).when(~null_word, text)


def json_reply(c: Column) -> Column:
    """A reply's JSON object as text, one code fence tolerated; null if it isn't an object."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(c), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", "")
    return F.when(F.coalesce(F.schema_of_variant(F.try_parse_json(bare)).startswith("OBJECT"), F.lit(False)), bare)


def json_block(c: Column) -> Column:
    """The widest {...} of a text if it parses."""
    block = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(F.nullif(block, F.lit(""))).isNotNull(), block)
