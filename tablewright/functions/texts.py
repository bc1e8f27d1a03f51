"""Column expressions over text: disguised gaps, capitalisation, numbers and dates written as text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens that stand for a missing value wherever they appear.
ALWAYS_MISSING = ["", "-", "--", "---", "?", "??", ".", "n/a", "n.a.", "n.a", "nan", "#error", "#value!", "#ref!", "#n/a", "#na", "#null!", "#div/0!", "<na>", "<null>"]
# Tokens that are an answer in some columns and a gap in others.
SOMETIMES_MISSING = ["na", "null", "none", "nil", "missing", "unknown", "undefined", "not available", "not applicable", "not specified", "not provided", "error"]
# Exact tokens that delimited text files use for a gap.
FILE_MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
FILE_MISSING_MORE = ["-", "--", "---", "?", "??", ".", "n.a.", "n.a", "nil", "missing", "unknown", "undefined", "error", "#error", "not available", "not applicable", "not specified", "not provided", "#value!", "#ref!", "#na", "<null>"]

# Names and shapes of columns that hold dates.
TEMPORAL_NAME = r"(^|_)(date|datetime|timestamp|time|day|month|year|dob|created|updated|modified)($|_)"
TEMPORAL_SHAPE = r"[-/:]|\d{4}"
#: Forms in which dates are read; where day and month are ambiguous, the month is first.
TIMESTAMP_FORMATS = ["yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]", "yyyy-MM-dd HH:mm:ss[.SSSSSS]", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy", "M/d/yyyy", "MM-dd-yyyy", "dd-MMM-yyyy", "dd MMM yyyy", "MMM d, yyyy", "MMM d yyyy", "yyyyMMdd"]

FREE_TEXT_WORDS, FREE_TEXT_CHARS = 3.5, 40
IDENTIFIER_ROWS, IDENTIFIER_SHARE = 20, 0.9


def token(text: Column) -> Column:
    return F.lower(F.trim(text))


def always_missing(text: Column) -> Column:
    return token(text).isin(ALWAYS_MISSING)


def sometimes_missing(text: Column) -> Column:
    return token(text).isin(SOMETIMES_MISSING)


def casing(text: Column) -> Column:
    """upper, lower, title, mixed, or none for text without letters."""
    upper, lower = F.upper(text), F.lower(text)
    return (
        F.when(~text.rlike(r"\p{L}"), "none")
        .when((text == upper) & (text != lower), "upper")
        .when((text == lower) & (text != upper), "lower")
        .when(text.rlike(r"^\P{L}*(\p{Lu}\p{Ll}*(\P{L}+|$))+$"), "title")
        .otherwise("mixed")
    )


def squeezed(text: Column) -> Column:
    """Trimmed, with each run of white space as one space."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


# Fixed value: how a number is written once currency, separators and spaces are out; brackets stand for a minus.
NUMBER = r"^(\()?([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)%?(\))?$"


def number_of(text: Column) -> Column:
    """The number that a text writes: thousands separators, currency, percent and brackets for a negative; else null."""
    trimmed = F.trim(text)
    bare = F.regexp_replace(trimmed, r"[$€£₹¥₩₽,\s]", "")
    opened = F.startswith(bare, F.lit("("))
    fits = (opened == F.endswith(bare, F.lit(")"))) & (opened == F.startswith(trimmed, F.lit("(")))
    value = F.regexp_extract(bare, NUMBER, 2).try_cast("double")
    return F.when(fits, value * F.when(opened, -1.0).otherwise(1.0) / F.when(F.contains(bare, F.lit("%")), 100.0).otherwise(1.0))


#: What every date in one of the forms begins with; anything else is not tried.
DATE_START = r"^\s*(\d{4}[-/]|\d{1,2}[-/]|\d{2} \p{L}|\p{L}{3} \d|\d{8}\s*$)"


def timestamp_of(text: Column) -> Column:
    return F.when(text.rlike(DATE_START), F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(f)) for f in TIMESTAMP_FORMATS]))


def leading_zero(text: Column) -> Column:
    return F.trim(text).rlike(r"^0\d+")


#: Shapes of dates and times: digits as 0, letters as a.
DATE_SHAPE = r"^(0000([-/.])00?(?:\2)00?|00?([-/.])00?(?:\3)0000|00?[- ]a{3,9}[- ]0000|00? a{3,9},? 0000|a{3,9} 00?,? 0000|0{8})([a ]00?:00(:00(\.0{1,9})?)?( ?aa)?( ?(a|[+-]00:?00))?)?$"


def shape_of(text: Column) -> Column:
    """A text with each digit as 0 and each letter of the alphabet as a; null beyond the length of any date."""
    trimmed = F.trim(text)
    return F.when(F.length(trimmed) <= 45, F.translate(F.lower(trimmed), "123456789bcdefghijklmnopqrstuvwxyz", "0" * 9 + "a" * 25))


def form_of_shape(shape: str, day_first: bool = False) -> str | None:
    """How dates of a shape are read; null for what is no shape of a date."""
    whole = re.match(DATE_SHAPE, shape)
    if not whole:
        return None
    rest = whole.group(4) or ""
    date = shape[: len(shape) - len(rest)]
    if re.match("0000[-/.]", date):
        form = f"yyyy{date[4]}M{date[4]}d"
    elif ambiguous(shape):
        sep = re.search("[-/.]", date).group()
        form = f"{'d' if day_first else 'M'}{sep}{'M' if day_first else 'd'}{sep}yyyy"
    elif date == "0" * 8:
        form = "yyyyMMdd"
    else:
        named = re.sub("a+", lambda m: "MMM" if len(m.group()) == 3 else "MMMM", date)
        form = re.sub(r"(?<!0)00?(?!0)", "d", named.replace("0000", "yyyy"))
    if not rest:
        return form
    half = bool(re.search(r":00(\.0+)? ?aa", rest))
    clock = re.match(r"([a ])(00?):00(:00(\.(0{1,9}))?)?( ?)(aa)?( ?)(a|[+-]00:?00)?$", rest)
    form += ("'T'" if clock.group(1) == "a" else " ") + ("h" if half else "H") + ":mm" + (":ss" if clock.group(3) else "")
    form += "." + "S" * len(clock.group(5)) if clock.group(5) else ""
    form += clock.group(6) + "a" if half else ""
    zone = clock.group(9) if half else re.search(r"( ?)(a|[+-]00:?00)$", rest)
    if half:
        return form + (clock.group(8) + ("XXX" if ":" in zone or zone == "a" else "XX") if zone else "")
    return form + (zone.group(1) + ("XX" if re.fullmatch("[+-]0000", zone.group(2)) else "XXX") if zone else "")


def ambiguous(shape: str) -> bool:
    """Whether day and month both come first in dates of a shape."""
    return bool(re.match(r"00?([-/.])00?(?:\1)0000", shape))


def dates_of(text: Column, forms: dict[str, str | None]) -> Column:
    """Dates of a column by the form chosen for each shape, each value read once; a form of None leaves it to the value whether its day comes first."""
    trimmed, shape = F.trim(text), shape_of(text)
    by_form: dict[tuple[str, str | None], list[str]] = {}
    for s, form in forms.items():
        pair = (form, None) if form else (form_of_shape(s), form_of_shape(s, True))
        by_form.setdefault(pair, []).append(s)
    found = None
    for (form, other), shapes in by_form.items():
        read = F.try_to_timestamp(trimmed, F.lit(form))
        if other:
            read = F.when(F.regexp_extract(trimmed, r"^(\d+)", 1).try_cast("int") > 12, F.try_to_timestamp(trimmed, F.lit(other))).otherwise(read)
        found = F.when(shape.isin(shapes), read) if found is None else found.when(shape.isin(shapes), read)
    return F.lit(None).cast("timestamp") if found is None else found
