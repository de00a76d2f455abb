"""Table schemas (DDL text) of the data model and the words its columns use."""

from __future__ import annotations

MOVEMENT_COLUMNS = {
    "chain": "string", "txid": "string", "ts": "bigint", "from_address": "string",
    "to_address": "string", "asset": "string", "value": "double",
    "value_raw": "decimal(38,0)", "is_self_transfer": "boolean",
    "token_contract": "string", "transfer_kind": "string", "oversize": "boolean",
    "value_limbs": "array<bigint>"}
MOVEMENTS = ", ".join(f"{name} {kind}" for name, kind in MOVEMENT_COLUMNS.items())

LABELS = (
    "address string, chain string, entity_name string, category string, "
    "source string, confidence string, updated_utc string")

WALLET_FLAGS = (
    "address string, chain string, reason string, case_id bigint, "
    "created_utc string")

WATCHES = (
    "address string, chain string, note string, case_id bigint, "
    "baseline_tx_count bigint, baseline_balance decimal(38,0), "
    "last_checked_utc string, alert_json string, acknowledged boolean")

RAW_UTXO = (
    "txid string, status struct<block_time: bigint>, "
    "vin array<struct<prevout: struct<scriptpubkey_address: string, value: bigint>>>, "
    "vout array<struct<scriptpubkey_address: string, value: bigint>>")

RAW_ACCOUNT_TX = (
    "hash string, `from` string, `to` string, value string, "
    "timeStamp string, isError string")

RAW_ACCOUNT_TOKEN = (
    "hash string, `from` string, `to` string, contractAddress string, "
    "tokenSymbol string, tokenDecimal string, value string, timeStamp string")

RAW_INDEXED = (
    "category string, `from` string, `to` string, hash string, asset string, "
    "rawContract struct<value: string, address: string, decimal: string>, "
    "metadata struct<blockTimestamp: string>")

RAW_TRON_NATIVE = (
    "txID string, block_timestamp bigint, raw_data struct<contract: array<"
    "struct<type: string, parameter: struct<value: struct<amount: bigint, "
    "owner_address: string, to_address: string>>>>>")

RAW_TRON_TOKEN = (
    "type string, `from` string, `to` string, transaction_id string, "
    "value string, block_timestamp bigint, "
    "token_info struct<address: string, symbol: string, decimals: string>")

CUSTODY_LOG = (
    "id bigint, trace_id bigint, source string, url string, "
    "http_status int, sha256 string, from_cache boolean, fetched_utc string")

FLAG_PACK = (
    "format string, generator string, agency struct<name: string, contact: string>, "
    "exported_utc string, note string, flag_count bigint, "
    "flags array<struct<address: string, chain: string, reason: string, "
    "flagged_utc: string>>, sha256 string")

SCAM_REPORTS = (
    "address string, chain string, fetched_utc string, count bigint, "
    "reports array<struct<id: string, scamCategory: string, createdAt: string, "
    "trusted: boolean, checked: boolean, isPrivate: boolean, description: string, "
    "addresses: array<struct<address: string, chain: string, domain: string>>, "
    "losses: array<struct<amount: double, asset: string>>>>")

# ---- fixed values -------------------------------------------------------
BITCOIN, ETHEREUM, TRON = "bitcoin", "ethereum", "tron"
MONERO, LITECOIN = "monero", "litecoin"
ACCOUNT_CHAINS = (ETHEREUM,)

FORWARD, BACKWARD = "forward", "backward"
RAPID, BALANCED, THOROUGH = "rapid", "balanced", "thorough"

VICTIM = "victim"
INTERMEDIARY = "intermediary"
EXCHANGE = "exchange"
SANCTIONED = "sanctioned"
MIXER = "mixer"
HIGH_ACTIVITY = "high_activity_service"
CONTRACT = "contract"
UNEXPANDED = "unexpanded"
STOP_ROLES = (EXCHANGE, SANCTIONED, MIXER, CONTRACT, HIGH_ACTIVITY)
# Strongest role first; used when several traces disagree about a wallet.
ROLE_PRIORITY = (VICTIM, EXCHANGE, SANCTIONED, MIXER, HIGH_ACTIVITY, CONTRACT,
                 INTERMEDIARY, UNEXPANDED)

FLAGGED, SHARED_FLAG, SCAM_REPORT = "flagged", "shared_flag", "scam_report"
ATTRIBUTION = (EXCHANGE, MIXER, SANCTIONED, "other")

STABLECOINS = ("USDT", "USDC")
STABLECOIN_ISSUERS = {"USDT": "Tether", "USDC": "Circle"}
PRICED_ASSETS = ("BTC", "ETH", "TRX")
ASSET_DECIMALS = {"BTC": 8, "ETH": 18, "TRX": 6}
# ---- end of fixed values ------------------------------------------------
