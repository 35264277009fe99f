"""Seeded chance that any engine can repeat: a number from the MD5 of a seed and what it is drawn for."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, functions as F


def uniform(seed: int, *of: Column | str) -> Column:
    """A number in [0, 1) with 32 bits for the values ``of``, which are written with colons between."""
    named = F.concat_ws(":", F.lit(str(seed)), *[(F.col(x) if isinstance(x, str) else x).cast("string") for x in of])
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def uniform_here(seed: int, *of) -> float:
    """The same number in Python."""
    return int(hashlib.md5(":".join(map(str, (seed, *of))).encode()).hexdigest()[:8], 16) / 4294967296


def uniform_sql(seed: int, *of: str) -> str:
    """The same number in DuckDB's SQL."""
    return f"(('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(of)})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
