"""Column -> Column cleaning rules for raw feed values.

Everything here is a built-in Spark expression, so it stays inside whole-stage
code generation.  A missing value is always null, never zero or an empty text.
Rounding is half-up (``floor(x + 0.5)``), not Spark's half-away-from-zero.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that mean "no value" once surrounding blanks are removed.
MISSING_TEXTS = ("", "-", "N/A", "null")

# All blanks, Unicode spaces and line ends included; Java's \s has ASCII ones only.
BLANK_CHARACTERS = (
    " \t\n\x0b\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
BLANK = f"[{BLANK_CHARACTERS}]"
NUMBER_CLUTTER = BLANK_CHARACTERS + ",%₩"
NUMBER_SHAPE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

LARGEST_DOUBLE = 1.7976931348623157e308
# From here on a double has no fraction and does not surely fit a long.
LARGEST_SCALED = 9.0e18
SEOUL_OFFSET_SECONDS = 9 * 3600


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Remove leading and trailing blanks, the no-break space included."""
    return F.trim(col(c), F.lit(BLANK_CHARACTERS))


def nullify(c: Column | str) -> Column:
    c = col(c)
    return F.when(~strip(c).isin(*MISSING_TEXTS), c)


def finite(c: Column | str) -> Column:
    """NaN and the infinities are not values."""
    c = col(c).cast("double")
    return F.when(F.abs(c) <= F.lit(LARGEST_DOUBLE), c)


def not_finite(c: Column | str) -> Column:
    c = col(c)
    return F.coalesce(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(False))


def parse_number(c: Column | str) -> Column:
    """``'1,234'`` -> 1234.0, ``'12.5%'`` -> 12.5, ``'abc'`` -> null.

    ``nullif`` computes its argument once, where a ``when`` would repeat the whole
    chain; a cast of text that is no number would be slow, so none is tried.
    """
    bare = F.translate(nullify(c), NUMBER_CLUTTER, "")
    number = F.nullif(F.regexp_extract(bare, NUMBER_SHAPE, 0), F.lit("")).try_cast("double")
    infinity = float("inf")
    return F.nullif(F.nullif(number, F.lit(infinity)), F.lit(-infinity))


def normalize_code(c: Column | str) -> Column:
    """Digits only, one to six of them, left-padded to six."""
    digits = F.regexp_replace(nullify(c), r"[^0-9]", "")
    return F.when(digits.rlike("^[0-9]{1,6}$"), F.lpad(digits, 6, "0"))


def normalize_etf_code(c: Column | str) -> Column:
    """Pad all-digit codes to six; keep alphanumeric codes, upper-cased."""
    text = strip(F.coalesce(col(c), F.lit("")))
    return F.when(text.rlike("^[0-9]{1,5}$"), F.lpad(text, 6, "0")).otherwise(F.upper(text))


def lookup_code(c: Column | str) -> Column:
    """Key of the holdings lookup: all digits of the text padded to six, else upper case."""
    text = strip(F.coalesce(col(c), F.lit("")))
    digits = F.regexp_replace(text, r"[^0-9]", "")
    padded = F.lpad(digits, F.greatest(F.lit(6), F.length(digits)), F.lit("0"))
    return F.when(digits == "", F.upper(text)).otherwise(padded)


def normalize_asset_code(c: Column | str) -> Column:
    """Domestic codes are padded to six digits, tickers and ISINs stay as they are."""
    return padded_asset_code(clean_text(c))


def padded_asset_code(c: Column | str) -> Column:
    """:func:`normalize_asset_code` for a text that is clean already."""
    text = col(c)
    digits = F.regexp_replace(text, r"[^0-9]", "")
    return F.when(text.rlike("^[A-Za-z]?[0-9]{1,6}$"), F.lpad(digits, 6, "0")).otherwise(text)


def clean_text(c: Column | str) -> Column:
    """Squash runs of blanks to one space and trim.

    All blanks become spaces first: a pattern of one character is several times as fast as
    one of a class that goes beyond Latin.
    """
    spaced = F.translate(nullify(c), BLANK_CHARACTERS, " " * len(BLANK_CHARACTERS))
    return F.trim(F.regexp_replace(spaced, " {2,}", " "))


def seoul_wall_clock(instant: Column | str) -> Column:
    """ISO text at +09:00 of a UTC instant, whatever the session time zone is."""
    seconds = F.unix_seconds(col(instant)) + F.lit(SEOUL_OFFSET_SECONDS)
    days = F.floor(seconds / F.lit(86400)).cast("int")
    clock = seconds - days.cast("bigint") * F.lit(86400)
    return F.concat(
        F.date_add(F.lit("1970-01-01").cast("date"), days).cast("string"),
        F.lit("T"),
        *_joined_clock(clock),
        F.lit("+09:00"),
    )


def _joined_clock(seconds: Column) -> list[Column]:
    def two(x: Column) -> Column:
        return F.lpad(F.floor(x).cast("string"), 2, "0")

    hours = two(seconds / 3600)
    minutes = two((seconds % 3600) / 60)
    return [hours, F.lit(":"), minutes, F.lit(":"), two(seconds % 60)]


def to_seoul_iso(c: Column | str) -> Column:
    """``YYYYMMDD``, ``YYYY-MM-DD`` or an ISO instant -> ISO text at +09:00."""
    text = strip(nullify(c))
    compact = F.concat_ws(
        "-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2)
    )
    midnight = F.lit("T00:00:00+09:00")
    return (
        F.when(text.rlike("^[0-9]{8}$"), F.concat(compact, midnight))
        .when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.concat(text, midnight))
        .otherwise(seoul_wall_clock(F.try_to_timestamp(text)))
    )


def epoch_ms_to_seoul_iso(c: Column | str) -> Column:
    return seoul_wall_clock(F.timestamp_millis(col(c).cast("bigint")))


def to_date_only(c: Column | str) -> Column:
    return F.substring(to_seoul_iso(c), 1, 10).try_cast("date")


def to_percent(c: Column | str, from_ratio: bool = False) -> Column:
    number = parse_number(c)
    return number * 100 if from_ratio else number


def sign_of(c: Column | str) -> Column:
    return F.signum(finite(c)).cast("int")


def half_up(x: Column | str, digits: int = 0) -> Column:
    """Round half towards plus infinity; the result stays a double.

    What is not finite is missing.  A number too large for a long once scaled has no digits
    to round and stays as it is.
    """
    scale = 10**digits
    scaled = col(x).cast("double") * F.lit(float(scale))
    rounded = F.floor(scaled + F.lit(0.5)).cast("double") / F.lit(float(scale))
    small = F.abs(scaled) < F.lit(LARGEST_SCALED)
    return F.when(small, rounded).when(F.abs(col(x)) <= F.lit(LARGEST_DOUBLE), col(x).cast("double"))


def pct_change(current: Column | str, base: Column | str) -> Column:
    """Change in percent at two decimals; null when a side is missing, not finite, or the base is 0."""
    current, base = col(current), col(base)
    points = (current - base) / F.nullif(base, F.lit(0.0)) * F.lit(10000.0)
    rounded = F.floor(points + F.lit(0.5)).cast("double") / F.lit(100.0)
    exact = F.when(F.abs(points) <= F.lit(LARGEST_DOUBLE), points / F.lit(100.0))
    return F.when(F.abs(points) < F.lit(LARGEST_SCALED), rounded).otherwise(exact)


def to_eok(c: Column | str) -> Column:
    """Won -> whole units of 1e8 won."""
    return half_up(parse_number(c) / F.lit(1e8))


def delay_minutes(as_of: Column | str, now: Column) -> Column:
    seconds = (F.unix_micros(now) - F.unix_micros(col(as_of))) / F.lit(1e6)
    return F.greatest(F.lit(0), F.floor(seconds / 60 + F.lit(0.5))).cast("bigint")


def is_delayed(as_of: Column | str, now: Column, threshold: int = 1) -> Column:
    return F.coalesce(delay_minutes(as_of, now) >= F.lit(threshold), F.lit(False))


def clamp01(c: Column | str) -> Column:
    c = col(c).cast("double")
    # greatest() and least() skip nulls, so a missing number has to be kept out first.
    given = c.isNotNull() & ~F.isnan(c)
    return F.when(given, F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def name_key(c: Column | str) -> Column:
    """Secondary join key: lower case without blanks."""
    return F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), BLANK, "")


def first_present(row: Column | str, keys: list[str] | tuple[str, ...]) -> Column:
    """Value of the first key the map *has*, even if that value is null.

    ``array_intersect`` keeps the order of its first array, so one expression
    finds the key; a chain of ``when`` per key makes methods too big to compile.
    """
    wanted = F.array(*[F.lit(key) for key in keys])
    return col(row)[F.get(F.array_intersect(wanted, F.map_keys(row)), F.lit(0))]


def _units(value: Column, scale: int) -> tuple[Column, Column]:
    """A finite number in units of the last of ``scale`` digits, as a double, and is it off a whole one?

    A billionth of a unit, or of the number, passes for rounding of binary fractions.
    """
    scaled = value * F.lit(float(10**scale))
    slack = F.lit(1e-9) * F.greatest(F.lit(1.0), F.abs(scaled))
    return F.rint(scaled), F.abs(scaled - F.rint(scaled)) > slack


def _refused(value: Column, scale: int) -> Column:
    return F.raise_error(F.concat(value.cast("string"), F.lit(f" does not fit decimal(28,{scale})")))


def exact_decimal(c: Column | str, scale: int) -> Column:
    """A finite number as decimal(28, ``scale``); what is not finite is missing.

    A number with more digits after the point, or too large, is an error and not cut.
    """
    value = finite(c)
    decimal = value.try_cast(f"decimal(28,{scale})")
    _, off = _units(value, scale)
    refused = _refused(value, scale).cast(f"decimal(28,{scale})")
    return F.when(value.isNull(), F.lit(None)).when(decimal.isNull() | off, refused).otherwise(decimal)


#: Whole numbers up to here are exact as doubles.
_WHOLE = float(1 << 53)
_LIMB_BITS = 20


def exact_sum(c: Column | str, scale: int) -> Column:
    """Sum of finite numbers that does not depend on row order or partitioning.

    ``scale`` is how many digits the numbers have after the point.  Numbers are added as
    whole units in two longs, of the high and the low bits, which take a thousand million
    of the largest; a sum beyond that is an error.  Numbers of more than 53 bits are added as
    decimals, which would be slow for all.
    """
    value = finite(c)
    units, off = _units(value, scale)
    small = F.abs(units) <= F.lit(_WHOLE)
    whole = F.when(small & off, _refused(value, scale).cast("bigint")).when(small, units.cast("bigint"))
    high, low = F.sum(F.shiftright(whole, _LIMB_BITS)), F.sum(whole.bitwiseAND(F.lit((1 << _LIMB_BITS) - 1)))
    joined = high.cast("decimal(20,0)") * F.lit(1 << _LIMB_BITS).cast("decimal(8,0)") + low.cast("decimal(20,0)")
    scaled = (joined * F.lit(f"1e-{scale}").cast(f"decimal({scale + 1},{scale})")).cast(f"decimal(38,{scale})")
    large = F.sum(F.when(~small, exact_decimal(value, scale)))
    both = F.coalesce(scaled, F.lit(0).cast("decimal(1,0)")) + F.coalesce(large, F.lit(0).cast("decimal(1,0)"))
    return F.when(high.isNotNull() | large.isNotNull(), both).cast("double")


def exact_mean(c: Column | str, scale: int) -> Column:
    """Mean of the finite numbers; null if there are none."""
    value = finite(c)
    return exact_sum(value, scale) / F.nullif(F.count(value), F.lit(0))
