"""Deterministic keys: hash-ordered draws and order-insensitive fingerprints.

All draws hash with md5 so that any engine can repeat them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

_SPAN = 4294967296.0  # 2**32, the range of eight hex digits


def md5_key(*parts: Column | str | int) -> Column:
    """md5 of the parts joined with ``:``; strings name columns, integers are literals."""
    cols = [F.lit(str(p)) if isinstance(p, int) else (F.col(p) if isinstance(p, str) else p)
            for p in parts]
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in cols]))


def hex_number(digits: Column) -> Column:
    """Hex digits as a bigint."""
    return F.conv(digits, 16, 10).cast("bigint")


def key_number(key: Column) -> Column:
    """First eight hex digits of a key as a bigint in [0, 2**32)."""
    return hex_number(F.substring(key, 1, 8))


def key_uniform(key: Column) -> Column:
    """First eight hex digits of a key as a double in [0, 1)."""
    return key_number(key).cast("double") / F.lit(_SPAN)


def key_normal(key: Column) -> Column:
    """Standard normal draw from one key (Box-Muller on its two halves)."""
    u1 = (key_number(key) + F.lit(1)).cast("double") / F.lit(_SPAN)
    u2 = F.conv(F.substring(key, 9, 8), 16, 10).cast("double") / F.lit(_SPAN)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def poisson_cdf(steps: int = 12) -> list[float]:
    """Cumulative probabilities of a Poisson variable with mean one."""
    total, out = 0.0, []
    for k in range(steps):
        total += math.exp(-1.0) / math.factorial(k)
        out.append(total)
    return out


def poisson_weight(uniform: Column) -> Column:
    """Poisson(1) draw by inverse distribution: how often a row enters a resample."""
    steps = poisson_cdf()
    weight = F.when(uniform < F.lit(steps[0]), 0)
    for k, p in enumerate(steps[1:], 1):
        weight = weight.when(uniform < F.lit(p), k)
    return weight.otherwise(len(steps))


def poisson_of_digits(digits: Column) -> Column:
    """:func:`poisson_weight` of the share that eight hex digits have of their range.

    Lower-case digits of one length are ordered as text like the numbers they write, so none is converted.
    """
    weight = None
    for k, p in enumerate(poisson_cdf()):
        first = math.ceil(p * _SPAN)
        below = digits < F.lit(f"{first:08x}") if first < _SPAN else F.lit(True)
        weight = F.when(below, k) if weight is None else weight.when(below, k)
    return weight.otherwise(len(poisson_cdf()))


def row_digest(columns: list[str]) -> Column:
    """sha256 of a row: every value with its length, so that no two rows collide by joining."""
    parts = []
    for name in columns:
        text = F.col(f"`{name}`").cast("string")
        parts.append(F.when(text.isNull(), F.lit("~")).otherwise(
            F.concat(F.length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat_ws("|", *parts), 256)
