"""Seeded, engine-independent "randomness".

Every random choice in the library is an order by ``md5(seed|key...)`` with
the key as tie-break, so Spark and plain SQL engines pick the same rows.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: 13 hex digits = 52 bits; u = (v + 1) / (2^52 + 1) lies in (0, 1]
HEX_DIGITS = 13
U_DEN = 4503599627370497.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def hkey(seed, *cols) -> Column:
    """md5 hex of ``seed|c1|c2...`` (columns cast to string)."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[_c(c).cast("string") for c in cols]))


def uniform(seed, *cols) -> Column:
    """Deterministic uniform in (0, 1] from the seeded md5 key."""
    h = hkey(seed, *cols)
    return (F.conv(F.substring(h, 1, HEX_DIGITS), 16, 10).cast("double") + F.lit(1.0)) / F.lit(U_DEN)


def uniform_of_hex(h: Column, offset: int = 1) -> Column:
    """Uniform from a later slice of an md5 hex (independent draws from one hash)."""
    return (F.conv(F.substring(h, offset, HEX_DIGITS), 16, 10).cast("double") + F.lit(1.0)) / F.lit(U_DEN)


# ---- SQL twins (DuckDB dialect) used by the oracle texts ------------------

def sql_hkey(seed, *exprs: str) -> str:
    parts = ", ".join(f"CAST({e} AS VARCHAR)" for e in exprs)
    return f"md5(concat_ws('|', '{seed}', {parts}))"


def sql_uniform(seed, *exprs: str) -> str:
    return sql_uniform_of_hex(sql_hkey(seed, *exprs))


def sql_uniform_of_hex(h: str, offset: int = 1) -> str:
    return f"((('0x' || substr({h}, {offset}, {HEX_DIGITS}))::BIGINT::DOUBLE + 1.0) / {U_DEN})"
