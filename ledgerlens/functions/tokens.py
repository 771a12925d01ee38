"""Signed, expiring tokens over columns: HMAC-SHA256 has no built-in function, so it is an Arrow-batched UDF."""

from __future__ import annotations

import base64
import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _mac(secret: bytes, body: str) -> str:
    return base64.urlsafe_b64encode(hmac.new(secret, body.encode(), hashlib.sha256).digest()).decode().rstrip("=")


def sign(secret: bytes, payload: Column, expires_at: Column) -> Column:
    """payload.expiry.signature; null for a null part."""

    @F.pandas_udf("string")
    def run(body: pd.Series, until: pd.Series) -> pd.Series:
        return pd.Series([None if b is None or pd.isna(u) else f"{b}.{int(u)}.{_mac(secret, f'{b}.{int(u)}')}" for b, u in zip(body, until, strict=True)], dtype=object)

    return run(payload, expires_at)


def verify(secret: bytes, token: Column, now: Column) -> Column:
    """The payload of a token whose signature holds (checked first, in constant time) and that hasn't expired; else null."""

    @F.pandas_udf("string")
    def run(tokens: pd.Series, at: pd.Series) -> pd.Series:
        out = []
        for t, n in zip(tokens, at, strict=True):
            body, _, mac = (t or "").rpartition(".")
            good = hmac.compare_digest(_mac(secret, body).encode(), mac.encode()) if body else False
            payload, _, until = body.rpartition(".")
            out.append(payload if good and until.isdigit() and int(until) >= n else None)
        return pd.Series(out, dtype=object)

    return run(token, now)
