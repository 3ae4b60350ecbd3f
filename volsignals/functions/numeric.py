"""Exact numeric column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Splits a double into two halves whose products with a small integer are exact (Veltkamp).
_SPLIT = 134217729.0


def round_exact(x: Column, digits: int) -> Column:
    """Round the double's true binary value, ties to even: 2.675 -> 2.67, 0.125 -> 0.12.

    ``round`` and ``bround`` round the shortest decimal text of the double instead, so they
    give 2.68 for the first. The sign of the exact distance to the tie decides; no UDF.
    """
    s = float(10**digits)
    a = F.abs(x)
    low = F.floor(a * s).cast("double")
    t = a * _SPLIT
    hi = t - (t - a)
    lo = a - hi
    past = (hi * s - (low + 0.5)) + lo * s
    n = low + F.when(past > 0, 1.0).when(past == 0, low % 2).otherwise(0.0)
    r = n / s
    return F.when(x < 0, -r).otherwise(r)


def fixed(fmt: str, digits: int, x: Column) -> Column:
    """Text of ``x`` with ``digits`` decimals under :func:`round_exact`."""
    return F.format_string(fmt, round_exact(x, digits))


#: Exact sums: 18 decimals, up to 10^20. A double goes in as its shortest decimal text.
EXACT = "decimal(38,18)"


def exact(x: Column) -> Column:
    """A double as a decimal, so that sums do not depend on row order; NULL beyond the range."""
    return x.try_cast(EXACT)


#: ``exact`` holds what is smaller.
EXACT_END = 1e20


def micros(x: Column) -> Column:
    """A double as whole millionths; NULL if its text has more than six decimals or it is a million or more.

    A number of at most 15 digits is the shortest text of the double next to it, so this is :func:`exact`
    without a decimal for each row. Sums over the days of a ticker, 3.7 million in years of four digits,
    stay within a long.
    """
    n = F.rint(x * 1e6)
    return F.when((F.abs(n) < 1e12) & (n / 1e6 == x), n.cast("bigint"))


def micros_mean(total: Column, n: Column) -> Column:
    """:func:`exact_mean` of a sum of :func:`micros`, without a decimal where the mean has at most 18 places.

    There the quotient of two whole numbers below 2^53 is the double next to the mean.
    """
    n = F.nullif(n, F.lit(0).cast("bigint"))
    short = (F.lit(10**12) % n == 0) & (F.abs(total) < 2**53)
    return F.when(short, total / (n * 1e6)).otherwise(exact_mean(micros_exact(total).cast(EXACT), n))


def micros_exact(total: Column) -> Column:
    """A sum of :func:`micros` as a decimal of 18 places."""
    return (total.cast("decimal(20,0)") * F.lit("0.000001").cast("decimal(6,6)")).cast("decimal(32,18)")


def exact_mean(total: Column, n: Column) -> Column:
    """Mean of an exact sum, divided before it is cut to a double; NULL when nothing was summed."""
    return F.try_divide(total, n.cast("decimal(20,0)")).cast("double")


def exact_total(x: Column) -> Column:
    """Aggregate: sum of doubles. NULL if one of them, or the sum, is beyond the range."""
    lost = F.count_if(x.isNotNull() & exact(x).isNull())
    return F.when(lost == 0, F.try_sum(exact(x)).cast("double"))


def clean_number(text: Column, thousands: bool = False) -> Column:
    """Text to double; anything that is not a plain finite number becomes NULL."""
    if thousands:
        text = F.regexp_replace(text, ",", "")
    plain = text.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$")
    x = text.try_cast("double")
    # "1e400" is a plain number whose double is infinite
    return F.when(plain & (F.abs(x) < float("inf")), x)


def finite(x: Column) -> Column:
    """What :func:`clean_number` makes of the text of a double or whole number."""
    x = x.cast("double")
    return F.when(F.abs(x) < float("inf"), x)


def clean_volume(text: Column, thousands: bool = False) -> Column:
    """Text to whole shares; bad or missing is 0, fractions are cut off."""
    return F.coalesce(clean_number(text, thousands).try_cast("bigint"), F.lit(0).cast("bigint"))


def whole(x: Column) -> Column:
    """What :func:`clean_volume` makes of the text of a double or whole number."""
    return F.coalesce(finite(x).try_cast("bigint"), F.lit(0).cast("bigint"))


def plain_date(day: Column) -> Column:
    """What :func:`clean_date` makes of the text of a date: years have four digits."""
    return F.when(F.year(day).between(0, 9999), day)


# fixed values: patterns of dates with a named month
DATE_FORMATS = (
    "d-MMM-yyyy", "d MMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d MMMM yyyy", "d-MMMM-yyyy",
)
_TIME = r"([ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|UTC|[+-]\d{2}:?\d{2})?)?$"
_YEAR_FIRST = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})" + _TIME
_YEAR_LAST = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})" + _TIME
_COMPACT = r"^(\d{4})(\d{2})(\d{2})$"


def _three(t: Column, pattern: str, year: int, month: int, day: int) -> Column:
    part = lambda k: F.regexp_extract(t, pattern, k)
    return F.concat_ws("-", part(year), part(month), part(day)).try_cast("date")


def clean_date(
    text: Column, formats: tuple[str, ...] = DATE_FORMATS, day_first: Column | None = None
) -> Column:
    """Text to date; NULL if it fits no spelling.

    Years first or last, with hyphens, slashes or points, padded or not; eight digits; named
    months by ``formats``. A time and a zone after the date are allowed and the date is taken as
    written. Where the year is last, ``day_first`` says which comes first; without it, slashes
    mean the month and hyphens and points the day. Text without digits is not tried at all.
    """
    t = F.trim(text)
    if day_first is None:
        day_first = ~t.contains("/")
    last = F.when(day_first, _three(t, _YEAR_LAST, 3, 2, 1)).otherwise(_three(t, _YEAR_LAST, 3, 1, 2))
    named = F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in formats]).cast("date")
    return (
        F.when(t.rlike(_YEAR_FIRST), _three(t, _YEAR_FIRST, 1, 2, 3))
        .when(t.rlike(_YEAR_LAST), last)
        .when(t.rlike(_COMPACT), _three(t, _COMPACT, 1, 2, 3))
        .when(t.rlike(r"\d"), named)
    )


def order_votes(text: Column) -> Column:
    """1 for a date that can only have the day first, -1 for the month first, else 0.

    Only text with the year last is taken apart: a cast of what is no number raises and catches an error inside.
    """
    t = F.trim(text)
    a, b = (F.regexp_extract(t, _YEAR_LAST, k).try_cast("int") for k in (1, 2))
    vote = F.when((a > 12) & (b <= 12), 1).when((b > 12) & (a <= 12), -1).otherwise(0)
    return F.when(t.rlike(_YEAR_LAST), vote).otherwise(0)
