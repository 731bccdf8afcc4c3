"""Text and identifier expressions."""

from __future__ import annotations

import random

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Single signs that don't count as words (fixed values).
SIGNS = ["(", "[", ",", ".", "!", "?", ":", ";", "]", ")"]


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def words(c: Column) -> Column:
    """Lower-case pieces between white space of any kind; none is empty, a null text has none."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\s+"), lambda w: w != "")


def plain_words(c: Column) -> Column:
    """Lower-case words after all but a-z and blanks were deleted (line breaks and hyphens glue what they part)."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z ]", ""), " +"), lambda w: w != "")


def values_of(c: Column) -> Column:
    """The stripped, non-empty values of a comma-separated field."""
    return F.filter(F.transform(F.split(c, ","), strip), lambda v: v != "")


def id_number(c: Column) -> Column:
    """A number below 2^60 for an identifier: the first fifteen hexadecimal digits of its MD5, the same in any engine."""
    return F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("long")


#: Modulus of the affine hashes: the prime 2^61 - 1.
P = (1 << 61) - 1


def coefficients(k: int, seed: int = 2021) -> list[tuple[int, int]]:
    """k pairs (a, b) of hashes (a x + b) mod P by a seeded rule, the same in every run, task and engine."""
    draw = random.Random(seed)
    return [(draw.randrange(1, 1 << 31), draw.randrange(1 << 60)) for _ in range(k)]


def affine(high: Column, low: Column, a: int, b: int) -> Column:
    """(a x + b) mod P of x = high * 2^30 + low (below 2^60), within 64 bits.

    a high is below 2^61, and 2^61 is 1 modulo P: times 2^30 its upper 30 bits come back as they are, its lower 31 bits move up.
    """
    top = high * F.lit(a)
    turned = F.shiftleft(top.bitwiseAND(F.lit((1 << 31) - 1)), 30) + F.shiftright(top, 31)
    return (turned + low * F.lit(a) + F.lit(b)) % F.lit(P)


#: The same in SQL: the number of an identifier, and a hash of it.
NUMBER_SQL = "('0x' || substr(md5({}), 1, 15))::BIGINT"


def affine_sql(x: str, a: int, b: int) -> str:
    return f"(({x}::HUGEINT * {a} + {b}) % {P})::BIGINT"


def halves(x: Column) -> tuple[Column, Column]:
    """High and low 30 bits of a number below 2^60."""
    return F.shiftright(x, 30), x.bitwiseAND(F.lit((1 << 30) - 1))


def bytes_mod(c: Column, modulus: int) -> Column:
    """The UTF-8 bytes of a string, read as one big-endian number, modulo `modulus` (< 2^54), by Horner's rule over its hex form."""
    digits = F.transform(F.split(F.hex(F.encode(c, "utf-8")), ""), lambda d: F.conv(d, 16, 10).cast("long"))
    return F.aggregate(F.filter(digits, lambda d: d.isNotNull()), F.lit(0).cast("long"), lambda a, d: (a * 16 + d) % modulus)


def key_sum(c: Column) -> Column:
    """Code of the first character plus code of the last; 0 for an empty string."""
    return F.ascii(c) + F.ascii(F.right(c, F.lit(1)))


def trailing_zeros(c: Column) -> Column:
    """Number of trailing zero bits of a non-negative number; 0 for 0."""
    return F.when(c == 0, F.lit(0)).otherwise(F.bit_count(c.bitwiseAND(-c) - 1))
