"""Numeric helpers: rounding, missing values, prices, waiting times."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code of each period in the address of a variation page.
PERIOD_CODES = {
    "dia": 1,
    "semana": 2,
    "mes": 3,
}

# Directions of a variation page.
VARIATIONS = ("alta", "queda")


def fixed(value: Column, digits: int) -> Column:
    """Text with a fixed number of decimals, ties away from zero.

    Rounds the exact binary value, as a browser does: 1.005 has the double just below it and
    gives ``1.00``. ``format_number`` already works on the exact value but takes ties to even;
    a tie with ``digits`` decimals exists only at odd multiples of ``2**-(digits + 1)``, and
    those are moved off the tie.
    """
    x = value.cast("double")
    halves = x * float(2 ** (digits + 1))
    tie = F.abs(F.pmod(halves, F.lit(2.0))) == 1.0
    moved = F.when(tie, x + F.signum(x) * float(2 ** -(4 * digits + 4))).otherwise(x + 0.0)
    pattern = "0." + "0" * digits if digits else "0"
    return F.call_function("format_number", moved, F.lit(pattern))


def round_half_even(value: Column, digits: int = 1) -> Column:
    """Scale, round half to even, scale back: the rounding of pandas, inside codegen."""
    scale = float(10**digits)
    return F.rint(value * scale) / scale


def nan_to_null(value: Column) -> Column:
    return F.nanvl(value, F.lit(None).cast("double"))


def or_none(value: Column) -> Column:
    """The number, or null where it is null, zero or NaN."""
    return F.nullif(nan_to_null(value.cast("double")), F.lit(0.0))


def preferred(*values: Column) -> Column:
    """First number that is neither null nor zero nor NaN."""
    return F.coalesce(*[or_none(value) for value in values])


def preferred_price(prices: Column) -> Column:
    """Market price of the holofoil variant, else of the normal one, else null."""
    return preferred(prices["holofoil"]["market"], prices["normal"]["market"])


def period_code(period: Column) -> Column:
    """Code of a period name, null for an unknown one."""
    pairs = [F.lit(part) for pair in PERIOD_CODES.items() for part in pair]
    return F.create_map(*pairs)[period]


def exponential_wait_ms(attempt: Column, first: int = 1000, ceiling: int = 10000) -> Column:
    """Milliseconds to wait after attempt 1, 2, 3, …: doubling up to a ceiling."""
    return F.least(F.lit(float(first)) * F.pow(F.lit(2.0), attempt - 1), F.lit(float(ceiling)))


def linear_wait_ms(attempt: Column, step: int = 10) -> Column:
    """Milliseconds to wait after attempt 1, 2, 3, …: one more step each time."""
    return attempt * step


def page_wait_seconds(attempt: Column) -> Column:
    """Seconds before a page is loaded again, after attempt 0, 1, 2, …"""
    return F.lit(5) + attempt * 3
