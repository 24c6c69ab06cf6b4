"""Scalar expressions: parsing, guards, units, dates, text and links."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text that stands for "no value" in landed feeds.
MISSING_TOKENS = ("", ".", "null")

ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
UTC_STAMP = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?Z$"
PLAIN_NUMBER = r"^-?(0|[1-9]\d*)(\.\d+)?$"
FILING_ID = r"^\d{10}-\d{2}-\d{6}$"
SHA256_HEX = r"^[0-9a-f]{64}$"
# Links that need no parser: their scheme, host and path can be read only one way.
PLAIN_HOST, PLAIN_PREFIX = r"[a-z0-9]+(\.[a-z0-9]+)*\.[a-z]+", r"(/[A-Za-z0-9_-]+)+"
PLAIN_LINK = r"^https://[a-z0-9.]+(/[A-Za-z0-9_-]+)+\.[hH][tT][mM][lL]?\z"


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def codes(rules: Sequence[tuple[Column, str]]) -> Column:
    """Array of the codes whose condition holds, in the given order.

    No code is empty. Unlike `array_compact`, `array_remove` compiles, and with it the conditions.
    """
    return F.array_remove(F.array(*[F.when(cond, F.lit(code)).otherwise(F.lit("")) for cond, code in rules]), "")


# --- numbers ---------------------------------------------------------------


def finite(value: Column | str) -> Column:
    """A double that is neither NaN nor infinite, else null (NaN sorts above all)."""
    c = as_col(value)
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def parse_number(text: Column | str) -> Column:
    """Text to a finite double: thousands separators go, missing tokens are null."""
    c = F.trim(as_col(text))
    number = F.replace(c, F.lit(","), F.lit("")).try_cast("double")
    return finite(F.when(~c.isin(*MISSING_TOKENS), number))


def parse_decimal(text: Column | str, *, allow_zero: bool = True, scale: int = 10) -> Column:
    """Text to a non-negative decimal, else null."""
    number = F.replace(as_col(text), F.lit(","), F.lit("")).try_cast(f"decimal(38,{scale})")
    return F.when(number >= 0 if allow_zero else number > 0, number)


def nonneg_int(value: Column | str) -> Column:
    c = as_col(value)
    return F.when((c >= 0) & (c == F.floor(c)), c.cast("bigint"))


def bounded_pct(value: Column | str) -> Column:
    c = as_col(value)
    return F.when(c.between(0, 100), c)


def scale_units(value: Column | str, divisor: float, dp: int | None = 6) -> Column:
    scaled = as_col(value) / F.lit(float(divisor))
    return scaled if dp is None else F.round(scaled, dp)


def basis_points(left: Column | str, right: Column | str) -> Column:
    return F.round((as_col(left) - as_col(right)) * 100, 4)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient that is null, not an error, for a zero denominator."""
    return numerator / F.nullif(denominator, F.lit(0).cast("double"))


def pct_change(current: Column | str, previous: Column | str) -> Column:
    return (ratio(as_col(current), as_col(previous)) - 1) * 100


def within(a: Column, b: Column, tolerance: float) -> Column:
    """Null-safe equality up to a tolerance; null agrees only with null."""
    return F.coalesce(F.abs(a - b) <= tolerance, a.isNull() & b.isNull())


# --- dates -----------------------------------------------------------------


def strict_date(text: Column | str) -> Column:
    c = as_col(text)
    # A cast reads this form faster than a date pattern does; ISO_DATE alone lets a line break follow.
    return F.when((F.length(c) == 10) & c.rlike(ISO_DATE), c.try_cast("date"))


def xs_date(text: Column | str) -> Column:
    """``xs:date``: the calendar part counts, an optional zone never shifts it."""
    zone = r"(?:Z|[+-](?:(?:0\d|1[0-3]):[0-5]\d|14:00))?"
    # A cast reads this one form faster than a date pattern does.
    day = F.regexp_extract(as_col(text), rf"^(\d{{4}}-\d{{2}}-\d{{2}}){zone}$", 1)
    return day.try_cast("date")


def optional_date(text: Column | str, code: str) -> tuple[Column, Column]:
    """(date or null, anomaly code when a supplied value did not parse)."""
    c = as_col(text)
    day = xs_date(c)
    return day, F.when(c.isNotNull() & day.isNull(), F.lit(code))


def midnight_date(stamp: Column | str) -> Column:
    """The date of a timestamp that lies exactly on midnight, else null."""
    ts = as_col(stamp).try_cast("timestamp")
    return F.when(F.date_trunc("day", ts) == ts, ts.cast("date"))


def utc_timestamp(text: Column | str) -> Column:
    """ISO timestamp with a mandatory offset, as an instant."""
    c = as_col(text)
    return F.when(c.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), c.try_cast("timestamp"))


def local_to_utc(stamp: Column, zone: str = "America/New_York") -> Column:
    return F.to_utc_timestamp(stamp, zone)


def plausible_release(stamp: Column, obs_date: Column, lo: int = 2, hi: int = 7) -> Column:
    """Keep a release stamp only when it follows the observation by lo..hi days."""
    return F.when(F.datediff(stamp.cast("date"), obs_date).between(lo, hi), stamp)


def quarter_ordinal(day: Column | str) -> Column:
    c = as_col(day)
    return F.year(c) * 4 + F.quarter(c) - 1


def quarter_end(ordinal: Column) -> Column:
    year = F.floor(ordinal / 4).cast("int")
    month = ((F.pmod(ordinal, F.lit(4)) + 1) * 3).cast("int")
    return F.last_day(F.make_date(year, month, F.lit(1)))


def quarter_label(day: Column | str) -> Column:
    c = as_col(day)
    return F.concat(F.year(c).cast("string"), F.lit("-Q"), F.quarter(c).cast("string"))


def years_before(day: Column | str, years: int) -> Column:
    """The same day k years earlier; 29 February becomes 28 February."""
    return F.add_months(as_col(day), -12 * years)


def calendar_key(day: Column | str) -> Column:
    """A number that grows with the date and shifts by exactly 744 per year.

    It turns "the last k calendar years, strictly before this row" into a plain
    numeric RANGE frame (see :func:`calendar_years_frame`). 29 February sits one
    step above 28 February, so its k-years-before bound still admits the 28th.
    """
    c = as_col(day)
    leap = (F.month(c) == 2) & (F.dayofmonth(c) == 29)
    slot = F.year(c) * 372 + F.month(c) * 31 + F.when(leap, 28).otherwise(F.dayofmonth(c))
    return (slot * 2 + F.when(leap, 1).otherwise(0)).cast("bigint")


def calendar_years_frame(years: int) -> tuple[int, int]:
    """RANGE bounds over :func:`calendar_key` for k years, the row itself excluded."""
    return -(744 * years + 1), -1


def weekday_on_or_after(day: Column) -> Column:
    """The day itself, or the following Monday for a weekend day."""
    shift = F.when(F.weekday(day) == 5, 2).when(F.weekday(day) == 6, 1).otherwise(0)
    return F.date_add(day, shift)


def weekday_on_or_before(day: Column) -> Column:
    shift = F.when(F.weekday(day) == 5, 1).when(F.weekday(day) == 6, 2).otherwise(0)
    return F.date_sub(day, shift)


def next_business_day(day: Column | str) -> Column:
    return weekday_on_or_after(F.date_add(as_col(day), 1))


def expected_next_update(day: Column | str, frequency: Column | str) -> Column:
    """Next Thursday for weekly series, next weekday for daily ones, else null."""
    c, f = as_col(day), as_col(frequency)
    return (
        F.when(f == "weekly", F.next_day(c, "Thu"))
        .when(f.isin("business_daily", "daily"), next_business_day(c))
    )


def local_deadline(day: Column, hour: int, minute: int, zone: str = "America/New_York") -> Column:
    """A wall-clock time on a date in a zone, as an instant."""
    local = day.cast("timestamp") + F.make_dt_interval(
        F.lit(0), F.lit(hour), F.lit(minute), F.lit(0)
    )
    return F.to_utc_timestamp(local, zone)


# --- text, flags and links -------------------------------------------------


def tri_state(text: Column | str) -> Column:
    """0/false, 1/true, absent; anything else is null, which callers report."""
    c = F.lower(F.trim(as_col(text)))
    return (
        F.when(as_col(text).isNull() | (c == ""), "UNKNOWN")
        .when(c.isin("0", "false"), "FALSE")
        .when(c.isin("1", "true"), "TRUE")
    )


def canonical_alias(text: Column | str, aliases: Mapping[str, str]) -> Column:
    """Trim, lower, unify separators, then map; unsupported text is null."""
    c = F.translate(F.lower(F.trim(as_col(text))), "- ", "__")
    pairs = [F.lit(x) for pair in aliases.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), c)


def redact(text: Column | str) -> Column:
    """The whole text with the values of keys masked."""
    return F.regexp_replace(as_col(text), r"(?i)(api_key=)[^&\s]+", "$1<redacted>")


def document_url(root: str, entity: Column, filing: Column, document: Column) -> Column:
    return F.concat_ws(
        "/", F.lit(root), entity.cast("bigint").cast("string"),
        F.regexp_replace(filing, "-", ""), document,
    )


def document_url_problems(
    url: Column | str, *, host: str, prefix: str, entity: Column, filing: Column
) -> Column:
    """Reasons why a link is not a direct document link for this filing.

    Most links are plain and right; only the others are parsed, once per rule.
    """
    c = as_col(url)
    path = F.try_parse_url(c, F.lit("PATH"))
    wanted = F.concat(
        F.lit(prefix), F.lit("/"), entity.cast("bigint").cast("string"),
        F.lit("/"), F.regexp_replace(filing, "-", ""), F.lit("/"),
    )
    tail = F.substring_index(path, "/", -1)
    problems = codes(
        [
            (F.coalesce(F.try_parse_url(c, F.lit("PROTOCOL")) != "https", F.lit(True)), "SCHEME"),
            (F.coalesce(F.lower(F.try_parse_url(c, F.lit("HOST"))) != host, F.lit(True)), "HOST"),
            (F.try_parse_url(c, F.lit("USERINFO")).isNotNull(), "CREDENTIALS"),
            (F.try_parse_url(c, F.lit("QUERY")).isNotNull(), "QUERY"),
            (F.try_parse_url(c, F.lit("REF")).isNotNull(), "FRAGMENT"),
            (c.rlike(r"/\.{1,2}(/|$)") | c.contains("%"), "TRAVERSAL"),
            (
                ~F.coalesce(
                    path.startswith(wanted)
                    & (F.concat(wanted, tail) == path)
                    & F.lower(tail).rlike(r"^[^/]+\.html?$"),
                    F.lit(False),
                ),
                "DOCUMENT",
            ),
        ]
    )
    if not (re.fullmatch(PLAIN_HOST, host) and re.fullmatch(PLAIN_PREFIX, prefix)):
        return problems
    whole = F.concat(F.lit(f"https://{host}"), wanted, F.substring_index(c, "/", -1))
    return F.when(c.rlike(PLAIN_LINK) & (whole == c), F.array().cast("array<string>")).otherwise(problems)


def signed_number(value: Column | str, dp: int, unit: str) -> Column:
    """A number as text with an explicit sign and its unit."""
    c = as_col(value)
    sign = F.when(c > 0, "+").otherwise("")
    return F.concat(sign, F.format_number(c, dp), F.lit(f" {unit}"))


def sign_label(value: Column | str, up: str, down: str, flat: str = "FLAT") -> Column:
    c = as_col(value)
    return (
        F.when(c.isNull(), "UNKNOWN").when(c > 0, up).when(c < 0, down).otherwise(flat)
    )
