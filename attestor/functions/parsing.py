"""Numbers, currencies, dates and periods as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestor.functions.text import blank, trimmed

# Fixed values, in their order of precedence. Words of one multiplier or code stand next to each other in that order.
SCALES = (
    (1e3, "thousand|thousands|k"),
    (1e5, "lakh|lakhs|lac|lacs"),
    (1e6, "million|millions|mn"),
    (1e7, "crore|crores|cr"),
    (1e9, "billion|billions|bn"),
    (1e12, "trillion|tn"),
)
CURRENCIES = (
    ("INR", r"₹|rs\.|\brs\b|\binr\b"),
    ("USD", r"\$|\busd\b"),
    ("EUR", r"€|\beur\b"),
    ("GBP", r"£|\bgbp\b"),
)
APPROXIMATE = (">", "<", "~", "≈", "+", "approx", "about", "over", "under")
PERCENT_UNITS = ("%", "percent", "percentage")
NUMBER = r"-?\d[\d,]*\.?\d*"
MONTHS = {
    "january": 1, "jan": 1, "february": 2, "feb": 2, "march": 3, "mar": 3, "april": 4, "apr": 4, "may": 5, "june": 6, "jun": 6,
    "july": 7, "jul": 7, "august": 8, "aug": 8, "september": 9, "sep": 9, "sept": 9, "october": 10, "oct": 10,
    "november": 11, "nov": 11, "december": 12, "dec": 12,
}
MONTH = "(" + "|".join(sorted(MONTHS, key=len, reverse=True)) + ")"
YEAR_MONTH_DAY = r"\b(\d{4})[-/](\d{1,2})[-/](\d{1,2})\b"
MONTH_DAY_YEAR = rf"\b{MONTH}\.?\s+(\d{{1,2}})\b[,\s]+(\d{{4}})"
DAY_MONTH_YEAR = rf"\b(\d{{1,2}})(?:st|nd|rd|th)?\s+{MONTH}\.?\s*,?\s*(\d{{4}})"
DAY_MONTH_YEAR_DIGITS = r"\b(\d{1,2})[-/](\d{1,2})[-/](\d{4})\b"
MONTH_YEAR = rf"\b{MONTH}\.?\s*'?\s*(\d{{2,4}})\b"
YEAR = r"\b((?:19|20)\d{2})\b"
MONTH_COUNTS = {"twelve": 12, "nine": 9, "six": 6, "three": 3, "one": 1}
MONTHS_ENDED = r"\b(twelve|nine|six|three|one|\d{1,2})\s*[-\s]?months?\b[^.]{0,20}?\bended\b"
YEAR_ENDED = r"\b(?:year|fiscal|financial year)\s+ended\b"
QUARTER_ENDED = r"\bquarter\s+ended\b"
QUARTER_OF_YEAR = r"\bQ([1-4])\s*[-\s]?FY\s*'?(\d{2,4})"
FINANCIAL_YEAR = r"\b(?:FY|fiscal(?:\s+year)?)\s*'?(\d{2,4})\b"


def first_of(cases: list[tuple[Column, object]], otherwise: object = None) -> Column:
    """The value of the first condition that holds: order decides, as in a CASE."""
    out = F.when(cases[0][0], cases[0][1])
    for condition, value in cases[1:]:
        out = out.when(condition, value)
    return out.otherwise(otherwise)


def bound(x: Column, use) -> Column:
    """use(x) with x evaluated once, however often the expression names it."""
    return F.element_at(F.transform(F.array(x), use), 1)


def scale_of(x: Column) -> Column:
    """Multiplier of the first scale, in the order of the table, with a word that has no ASCII letter beside it; 1 if none."""
    alone = lambda words: f"(?<![a-z])(?:{words})(?![a-z])"
    none = lambda low: ~low.rlike(alone("|".join(w for _, w in SCALES)))
    return bound(F.lower(x), lambda low: first_of([(none(low), F.lit(1.0)), *((low.rlike(alone(w)), F.lit(m)) for m, w in SCALES)], F.lit(1.0)))


def currency_of(x: Column) -> Column:
    none = lambda low: ~low.rlike("(?U)" + "|".join(w for _, w in CURRENCIES))
    return bound(F.lower(x), lambda low: first_of([(none(low), F.lit(None).cast("string")), *((low.rlike(f"(?U){w}"), F.lit(c)) for c, w in CURRENCIES)], F.lit(None).cast("string")))


def parse_number(value: Column, unit: Column, currency: Column | None = None) -> Column:
    """Struct of value, multiplier, negative, approximate, percentage, currency, failure.

    A bracket or minus in front means negative, closed or not; a percentage isn't scaled; the
    scale is looked for in the value, then in the unit. An empty value fails.
    """
    given = F.lit(None).cast("string") if currency is None else F.nullif(currency, F.lit(""))
    unit = F.coalesce(unit, F.lit(""))
    names = ("value", "multiplier", "negative", "approximate", "percentage", "currency", "failure")
    packed = lambda *columns: F.struct(*(c.alias(n) for c, n in zip(columns, names, strict=True)))
    approximate = "|".join("\\" + s if s in "+" else s for s in APPROXIMATE)

    def read(text: Column) -> Column:
        percentage = text.contains("%") | F.lower(trimmed(unit)).isin(*PERCENT_UNITS)
        code = F.coalesce(given, currency_of(text), currency_of(unit))
        scale = F.when(percentage, F.lit(1.0)).otherwise(bound(scale_of(text), lambda own: F.when(own != 1.0, own).otherwise(scale_of(unit))))

        def scaled(p: Column) -> Column:
            size = F.abs(F.replace(p["digits"], F.lit(","), F.lit("")).try_cast("double")) * p["scale"]
            failure = F.when(p["digits"] == "", F.concat(F.lit("no digits found in "), text)).when(size.isNull(), F.concat(F.lit("not a number: "), p["digits"]))
            return packed(F.when(p["negative"], -size).otherwise(size), F.when(p["digits"] == "", F.lit(1.0)).otherwise(p["scale"]), p["negative"], F.lower(text).rlike(approximate), percentage, code, failure)

        parts = F.struct(F.regexp_extract(text, f"(?U){NUMBER}", 0).alias("digits"), scale.alias("scale"), text.rlike("^[(-]").alias("negative"))
        return bound(parts, scaled)

    no = F.lit(False)
    nothing = packed(F.lit(None).cast("double"), F.lit(1.0), no, no, no, F.lit(None).cast("string"), F.lit("empty value"))
    return F.when(blank(value), nothing).otherwise(bound(trimmed(value), read))


def date_of(year: Column, month: Column, day: Column) -> Column:
    """The date of strings or numbers, or null unless it exists and its year is 1900 to 2100."""
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    made = F.concat(year.cast("string"), F.lit("-"), two(month), F.lit("-"), two(day)).try_cast("date")
    return bound(made, lambda d: F.when(d.between(F.lit("1900-01-01").cast("date"), F.lit("2100-12-31").cast("date")), d))


def full_year(digits: Column) -> Column:
    return bound(digits.try_cast("int"), lambda n: F.when(n < 100, n + 2000).otherwise(n))


def month_of(name: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in MONTHS.items() for x in pair)), F.nullif(F.lower(name), F.lit("")))


def parse_date(x: Column) -> Column:
    """The first form that occurs decides, even if what it says is no date."""

    def read(text: Column) -> Column:
        part = lambda p, i: F.regexp_extract(text, f"(?iU){p}", i)
        has = lambda p: text.rlike(f"(?iU){p}")
        return (
            F.when(has(YEAR_MONTH_DAY), date_of(part(YEAR_MONTH_DAY, 1), part(YEAR_MONTH_DAY, 2), part(YEAR_MONTH_DAY, 3)))
            .when(has(MONTH_DAY_YEAR), date_of(part(MONTH_DAY_YEAR, 3), month_of(part(MONTH_DAY_YEAR, 1)), part(MONTH_DAY_YEAR, 2)))
            .when(has(DAY_MONTH_YEAR), date_of(part(DAY_MONTH_YEAR, 3), month_of(part(DAY_MONTH_YEAR, 2)), part(DAY_MONTH_YEAR, 1)))
            .when(has(DAY_MONTH_YEAR_DIGITS), date_of(part(DAY_MONTH_YEAR_DIGITS, 3), part(DAY_MONTH_YEAR_DIGITS, 2), part(DAY_MONTH_YEAR_DIGITS, 1)))
            .when(has(MONTH_YEAR), F.last_day(date_of(full_year(part(MONTH_YEAR, 2)), month_of(part(MONTH_YEAR, 1)), F.lit(1))))
            .when(has(YEAR), date_of(part(YEAR, 1), F.lit(12), F.lit(31)))
        )

    return bound(trimmed(x), read)


def months_back(end: Column, months: Column | int) -> Column:
    """First day of the span of that many months that ends in the month of `end`."""
    n = F.lit(months) if isinstance(months, int) else months
    return F.trunc(F.add_months(end, F.lit(1) - n), "MM")


def parse_period(x: Column, end_month: Column, end_day: Column) -> Column:
    """Struct of start, end, months; all null if no period is named. The financial year's end is an argument."""
    span = lambda start, end, months: F.struct(start.alias("start"), end.alias("end"), months.cast("int").alias("months"))
    nothing = span(F.lit(None).cast("date"), F.lit(None).cast("date"), F.lit(None))
    year_end = lambda digits: bound(full_year(digits), lambda n: F.when(n.between(1, 9999), F.make_date(n, end_month, end_day)))

    def read(p: Column) -> Column:
        text, end = p["text"], p["end"]
        part = lambda pattern, i: F.regexp_extract(text, f"(?iU){pattern}", i)
        has = lambda pattern: text.rlike(f"(?iU){pattern}")
        quarter = F.add_months(months_back(year_end(part(QUARTER_OF_YEAR, 2)), 12), (part(QUARTER_OF_YEAR, 1).try_cast("int") - 1) * 3)
        named = bound(F.lower(part(MONTHS_ENDED, 1)), lambda w: F.coalesce(F.element_at(F.create_map(*(F.lit(v) for pair in MONTH_COUNTS.items() for v in pair)), w), w.try_cast("int")))
        dated = end.isNotNull()
        return (
            F.when(has(QUARTER_OF_YEAR), bound(quarter, lambda q: span(q, F.last_day(F.add_months(q, 2)), F.lit(3))))
            .when(dated & has(MONTHS_ENDED), bound(named, lambda n: span(months_back(end, n), end, n)))
            .when(dated & has(QUARTER_ENDED), span(months_back(end, 3), end, F.lit(3)))
            .when(dated & has(YEAR_ENDED), span(months_back(end, 12), end, F.lit(12)))
            .when(has(FINANCIAL_YEAR), bound(year_end(part(FINANCIAL_YEAR, 1)), lambda y: span(months_back(y, 12), y, F.lit(12))))
            .when(dated, span(end, end, F.lit(None)))
            .otherwise(nothing)
        )

    return F.when(blank(x), nothing).otherwise(bound(F.struct(trimmed(x).alias("text"), parse_date(x).alias("end")), read))


def is_year_end_phrase(x: Column) -> Column:
    return F.coalesce(x.rlike(f"(?iU){YEAR_ENDED}"), F.lit(False))
