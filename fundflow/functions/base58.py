"""Hex addresses to base58check text, as an Arrow batch step."""

from __future__ import annotations

import hashlib
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Executors get these functions by value, so they need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


ALPHABET = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def encode(hex_text: str | None) -> str | None:
    try:
        payload = bytes.fromhex(hex_text)
    except (TypeError, ValueError):
        return None
    check = hashlib.sha256(hashlib.sha256(payload).digest()).digest()[:4]
    number, digits = int.from_bytes(payload + check, "big"), []
    while number:
        number, digit = divmod(number, 58)
        digits.append(ALPHABET[digit])
    zeros = len(payload) - len(payload.lstrip(b"\0"))
    return ALPHABET[0] * zeros + "".join(reversed(digits))


@F.pandas_udf(T.StringType())
def base58check(values: pd.Series) -> pd.Series:
    known = {v: encode(v) for v in values.dropna().unique()}
    return values.map(known)
