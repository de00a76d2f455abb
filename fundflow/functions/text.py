"""Address, date and text expressions.  All stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fundflow import schemas as S


def strip(text: Column) -> Column:
    """Text without white space at its ends: blanks, tabs, line ends, no-break spaces."""
    return F.regexp_replace(text, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def norm_addr(address: Column, chain: Column) -> Column:
    """EVM addresses are lower-cased; every other format is case-sensitive."""
    evm = (F.coalesce(chain, F.lit("")) == S.ETHEREUM) | address.startswith("0x")
    return F.when(evm, F.lower(address)).otherwise(address)


# ---- fixed values: input formats, tested in this order -------------------
_FORMATS = (
    (r"^0x[a-fA-F0-9]{40}$", "address", S.ETHEREUM, True),
    (r"^0x[a-fA-F0-9]{64}$", "txid", S.ETHEREUM, True),
    (r"^(bc1)[a-z0-9]{20,80}$", "address", S.BITCOIN, True),
    (r"^[13][a-km-zA-HJ-NP-Z1-9]{25,34}$", "address", S.BITCOIN, True),
    (r"^[a-fA-F0-9]{64}$", "txid", S.BITCOIN, True),
    (r"^T[a-km-zA-HJ-NP-Z1-9]{33}$", "address", S.TRON, True),
    (r"^[48][0-9AB][a-km-zA-HJ-NP-Z1-9]{93}$", "address", S.MONERO, False),
    (r"^(ltc1[a-z0-9]{20,80}|[LM][a-km-zA-HJ-NP-Z1-9]{26,33})$", "address",
     S.LITECOIN, False),
)
# ---- end of fixed values -------------------------------------------------


def detect(raw: Column) -> Column:
    """Struct (kind, chain, traceable) for a pasted address or transaction."""
    value = strip(raw)
    unknown = F.struct(F.lit("unknown").alias("kind"),
                       F.lit(None).cast("string").alias("chain"),
                       F.lit(False).alias("traceable"))
    out = None
    for pattern, kind, chain, traceable in _FORMATS:
        hit = F.struct(F.lit(kind).alias("kind"), F.lit(chain).alias("chain"),
                       F.lit(traceable).alias("traceable"))
        test = value.rlike(pattern)
        out = F.when(test, hit) if out is None else out.when(test, hit)
    return out.otherwise(unknown)


def utc_date(ts: Column) -> Column:
    """UTC calendar day of unix seconds, whatever the session time zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"),
                      F.floor(ts / 86400).cast("int"))


def iso_text(ts: Column) -> Column:
    """'YYYY-MM-DD HH:MM:SS UTC'; '-' when the time is unknown."""
    second = F.pmod(ts, F.lit(86400))
    clock = F.format_string(
        "%02d:%02d:%02d", F.floor(second / 3600).cast("int"),
        F.floor(F.pmod(second, F.lit(3600)) / 60).cast("int"),
        F.pmod(second, F.lit(60)).cast("int"))
    return F.when(ts.isNull(), F.lit("-")).otherwise(
        F.concat(utc_date(ts).cast("string"), F.lit(" "), clock, F.lit(" UTC")))


def amount_text(value: Column, digits: int = 6) -> Column:
    """Grouped digits without trailing zeros, e.g. 1,234.5."""
    text = F.format_number(value, digits)
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"),
                            r"\.$", "")


def slug(text: Column) -> Column:
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-")
    out = F.regexp_replace(out, "^-+|-+$", "")
    return F.when(out == "", F.lit("agency")).otherwise(out)


def pipe_join(items: Column) -> Column:
    return F.array_join(items, " | ")


def clip(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def conf_rank(confidence: Column) -> Column:
    return (F.when(confidence == "high", 0).when(confidence == "medium", 1)
            .when(confidence == "low", 2).otherwise(3))


# ---- fixed values: explorer tag slugs and their categories ---------------
EXCHANGE_SLUGS = (
    "abra", "ascendex", "azbit", "bilaxy", "binance", "bitbank", "bitfinex",
    "bitflyer", "bitget", "bithumb", "bitmart", "bitmex", "bitstamp",
    "bittrex", "bitvavo", "blockfi", "blofin-exchange", "bybit",
    "celsius-network", "cex-io", "coinbase", "coincheck", "coindcx", "coinex",
    "coinjar", "coinone", "coinspot", "crypto-com", "delta-exchange",
    "deribit", "ftx", "gate-io", "gemini", "hitbtc", "hotbit", "htx", "huobi",
    "indodax", "korbit", "kraken", "kucoin", "latoken", "liquid", "mexc",
    "nexo", "okx", "poloniex", "shapeshift", "upbit", "uphold", "zb-com")
MIXER_SLUGS = ("ethereum-mixer", "mixer", "tornado-cash")
SCAM_SLUGS = ("blocked", "take-action")
NON_WALLET_TAG = (r"(?i)\b(token|stablecoin|contract|proxy|vesting|airdrop|"
                  r"staking|deployer)\b")
SANCTION_ASSET_CHAIN = {
    "ETH": S.ETHEREUM, "LTC": S.LITECOIN, "TRX": S.TRON, "USDC": S.ETHEREUM,
    "XBT": S.BITCOIN, "XMR": S.MONERO}
TAGPACK_CURRENCY_CHAIN = {
    "BTC": S.BITCOIN, "ETH": S.ETHEREUM, "LTC": S.LITECOIN, "TRX": S.TRON}
# ---- end of fixed values -------------------------------------------------


def tag_category(tag: Column, name: Column) -> Column:
    """Category of an explorer tag; contract-like names are never wallets."""
    return (F.when(F.coalesce(name, F.lit("")).rlike(NON_WALLET_TAG), "other")
            .when(tag.isin(*EXCHANGE_SLUGS), S.EXCHANGE)
            .when(tag.isin(*MIXER_SLUGS), S.MIXER)
            .when(tag.isin(*SCAM_SLUGS) | tag.endswith("-exploit")
                  | tag.endswith("-hack"), S.SCAM_REPORT)
            .otherwise("other"))


def lookup_literal(key: Column, mapping: dict[str, str]) -> Column:
    out = None
    for k, v in mapping.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out


def asset_chain(suffix: Column, address: Column) -> Column:
    """Chain of a sanctioned address: by asset, else by format, else suffix."""
    return F.coalesce(
        lookup_literal(suffix, SANCTION_ASSET_CHAIN),
        F.when(address.startswith("0x"), S.ETHEREUM),
        F.when(address.startswith("T") & (F.length(address) == 34), S.TRON),
        F.lower(suffix))


def entity_match(name: Column, directory: list[dict], key: str = "entity") -> Column:
    """Position of the first directory entry whose name occurs in ``name``.

    The directory is a small ordered file, so the test is one ordered chain of
    conditions evaluated inside the row: no join.  File order decides, hence a
    'Binance.US' label meets 'Binance' first if that stands earlier.
    """
    lowered = F.lower(F.coalesce(name, F.lit("")))
    out = None
    for i, item in enumerate(directory):
        test = F.contains(lowered, F.lit(item[key].lower()))
        out = F.when(test, F.lit(i)) if out is None else out.when(test, F.lit(i))
    return F.lit(None).cast("int") if out is None else out


def directory_field(position: Column, directory: list[dict], field: str) -> Column:
    values = F.array(*[F.lit(str(d.get(field) or "")) for d in directory]) \
        if directory else F.array().cast("array<string>")
    return F.when(position.isNotNull(), F.get(values, position))
