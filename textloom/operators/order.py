"""Digests that tell the order of rows, computed without sorting them.

Rows with a place (0, 1, 2, …) make one polynomial: each text's hash times a power of the base, the power its place,
modulo a prime. Sums of parts add up in any order, so tasks need not meet, and rows that change
places change the digest.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Parameters: a prime whose products fit 64 bits, a base for each of the two halves, and bits of a place per table.
PRIME, BASES, BITS = 2**31 - 1, (48_271, 69_621), 8


def _power_tables(base: int) -> list[Column]:
    tables = []
    for level in range(6):
        step, listed = pow(base, 1 << BITS * level, PRIME), [1]
        for _ in range((1 << BITS) - 1):
            listed.append(listed[-1] * step % PRIME)
        tables.append(F.from_json(F.lit(json.dumps(listed)), "array<bigint>"))
    return tables


def _power(tables: list[Column], place: Column) -> Column:
    """The base to the power of ``place``, below 2**48: one factor for each 8 bits of it."""
    power, prime = F.lit(1).cast("bigint"), F.lit(PRIME).cast("bigint")
    for level, table in enumerate(tables):
        digit = F.shiftright(place, BITS * level).bitwiseAND((1 << BITS) - 1).cast("int")
        power = F.pmod(power * F.get(table, digit), prime)
    return power


def order_digest(rows: DataFrame, place: str, text: str, by: Sequence[str] = (), also: Sequence[Column] = ()) -> DataFrame:
    """``(*by, rows, digest, *also)``: 62 bits of all texts in the order of ``place``, and other aggregates of the same pass."""
    prime = F.lit(PRIME).cast("bigint")
    sums = []
    for k, base in enumerate(BASES):
        # eight digits of an MD5 each
        sign = F.conv(F.substring(F.md5(text), 8 * k + 1, 8), 16, 10).cast("bigint")
        term = F.pmod(F.pmod(sign, prime) * _power(_power_tables(base), F.col(place).cast("bigint")), prime)
        sums.append(F.pmod(F.sum(term.cast("decimal(20,0)")), prime.cast("decimal(20,0)")).cast("bigint"))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(sums[0] * F.lit(1 << 31) + sums[1], F.lit(0)).alias("digest"), *also
    )
