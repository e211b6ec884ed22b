"""Repeatable random numbers from hashes: the same in any engine that has MD5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *keys: Column | str) -> Column:
    """A number in [0, 1) from 32 bits of an MD5 of the seed and the keys, joined by colons."""
    cols = [k if isinstance(k, Column) else F.col(k) for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols])), 1, 8), 16, 10).cast("double") / 4294967296.0


def uniform_sql(seed: int, *keys: str) -> str:
    return "(('0x' || substr(md5(concat_ws(':', " + ", ".join([f"'{seed}'", *[f"{k}::VARCHAR" for k in keys]]) + ")), 1, 8))::BIGINT / 4294967296.0)"
