"""Pseudo-random numbers that depend on nothing but a key, alike in every engine and run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*key: Column | str | int) -> Column:
    """A double in [0, 1) from 52 bits of the digest of the key's parts."""
    parts = [k if isinstance(k, Column) else F.lit(k) for k in key]
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def uniform_sql(*key: str) -> str:
    """The same in DuckDB."""
    return f"CAST(concat('0x', substr(sha256(concat_ws('|', {', '.join(key)})), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496::DOUBLE"
