"""Amount expressions: units, dust limits, ordering values, USD cents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fundflow import schemas as S
from fundflow.functions import wide
from fundflow.functions.text import strip

# Default dust limits in base units of assets with fixed decimals.
DUST_RAW = {"BTC": 10_000, "ETH": 10**15, "TRX": 5_000_000}
DUST_DISPLAY = {"BTC": 0.0001, "ETH": 0.001, "TRX": 5.0}
DUST_TOKEN = 1.0


def to_units(raw: Column, decimals: Column | int) -> Column:
    """Display amount: base units over ten to the number of decimals."""
    places = F.lit(decimals) if isinstance(decimals, int) else decimals
    return raw.cast("double") / F.pow(F.lit(10.0), places.cast("double"))


_MOST_UNITS = 10**25


def display_units(value: Column) -> Column:
    """Display amount as a whole number of 10^-10: exact to sum, and comparable
    between assets and tokens of any decimals.  Amounts beyond 10^25 units are
    held at that, so the largest stay the largest; sums of a thousand fit."""
    held = F.when(value.isNotNull(), F.least(value, F.lit(float(_MOST_UNITS)))) \
        .try_cast("decimal(36,10)")
    # whole units and fraction apart: their product types keep every digit
    whole = F.floor(held).cast("decimal(27,0)")
    shift = F.lit(10**10).cast("decimal(11,0)")
    fraction = (held - whole).cast("decimal(11,10)") * shift
    return (whole * shift).cast("decimal(38,0)") + fraction.cast("decimal(11,0)")


def dust_min(asset: Column, limits: dict[str, float] | None = None,
             token: float = DUST_TOKEN) -> Column:
    """Smallest display amount that is followed, per asset."""
    out = None
    for name, limit in {**DUST_DISPLAY, **(limits or {})}.items():
        out = F.when(asset == name, F.lit(float(limit))) if out is None \
            else out.when(asset == name, F.lit(float(limit)))
    return out.otherwise(F.lit(float(token)))


def peg(asset: Column, pegged=S.STABLECOINS) -> Column:
    return asset.isin(*pegged)


def usd_cents(value: Column, price: Column) -> Column:
    """Whole cents, half up, from a display amount and a daily price."""
    return F.floor(value * price * F.lit(100.0) + F.lit(0.5)).cast("bigint")


def order_value(asset: Column, value: Column, spot: dict[str, float] | None = None,
                pegged=S.STABLECOINS) -> Column:
    """Rank of a movement: peg, else spot price, else the bare amount."""
    out = F.when(peg(asset, pegged), value)
    for name, price in (spot or {}).items():
        out = out.when(asset == name, value * F.lit(float(price)))
    return out.otherwise(value)


# Amounts of more digits than this do not fit an exact decimal sum; they are
# flagged, and kept exactly as limbs (``functions.wide``).
MAX_DIGITS = 36
_CHUNK = 15


def _digits(text: Column) -> Column:
    return F.regexp_replace(strip(text), "^0+(?=[0-9])", "")


def parse_amount(text: Column) -> Column:
    """Exact integer of a decimal digit string; null when malformed or wider
    than MAX_DIGITS."""
    digits = _digits(text)
    good = digits.rlike("^[0-9]+$") & (F.length(digits) <= MAX_DIGITS)
    return F.when(good, digits).try_cast("decimal(38,0)")


def parse_limbs(text: Column) -> Column:
    """Exact integer of a decimal digit string of any width up to 81 digits."""
    return wide.from_digits(_digits(text))


def is_oversize(text: Column) -> Column:
    digits = _digits(text)
    return F.coalesce(digits.rlike("^[0-9]+$") & (F.length(digits) > MAX_DIGITS),
                      F.lit(False))


def _hex_digits(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit("0x0"))), "^0x0*", "")


def _hex_chunks(digits: Column, n: int):
    padded = F.lpad(digits, n * _CHUNK, "0")
    return [F.conv(F.substring(padded, i * _CHUNK + 1, _CHUNK), 16, 10) for i in range(n)]


def hex_amount(text: Column) -> Column:
    """Exact integer of a 0x quantity up to 116 bits, from 60-bit chunks."""
    digits = _hex_digits(text)
    good = digits.rlike("^[0-9a-f]*$") & (F.length(digits) <= 29)
    high, low = (c.cast("decimal(19,0)") for c in _hex_chunks(digits, 2))
    return F.when(good, (high * F.lit(2**60).cast("decimal(19,0)") + low)
                  .cast("decimal(38,0)"))


def hex_double(text: Column) -> Column:
    """Approximate value of a 0x quantity of any width up to 300 bits."""
    digits = _hex_digits(text)
    total = F.lit(0.0)
    for chunk in _hex_chunks(digits, 5):
        total = total * F.lit(float(2**60)) + chunk.cast("double")
    return F.when(digits.rlike("^[0-9a-f]{0,75}$"), total)
