"""Seeded string hashes and min-hashes as column expressions, bit-exact with 32-bit Java arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The multipliers as signed 32-bit numbers, and the shifts behind them.
FIRST, SECOND, SHIFT_1, SHIFT_2 = -862048943, 461845907, 15, 13


def wrap(x: Column) -> Column:
    """The signed 32-bit value of the low bits."""
    return (x.bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseXOR(F.lit(0x80000000))) - F.lit(0x80000000)


def code_units(text: Column) -> Column:
    """UTF-16 code units; characters beyond the first plane are surrogate pairs."""
    points = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("bigint"))
    pairs = F.flatten(F.transform(points, lambda p: F.when(p >= 65536, F.array(55296 + F.shiftright(p - 65536, 10), 56320 + (p - 65536) % 1024)).otherwise(F.array(p))))
    return F.when(text.rlike(r"[\x{10000}-\x{10FFFF}]"), pairs).otherwise(points)


def string_hash(text: Column) -> Column:
    """The 31-polynomial hash of a string."""
    # the sum stays below 2^37 and is cut to 32 bits at each step; its sign is set once
    total = F.aggregate(code_units(text), F.lit(0).cast("bigint"), lambda h, c: (h * 31 + c).bitwiseAND(F.lit(0xFFFFFFFF)), wrap)
    return F.when(text == "", F.lit(0).cast("bigint")).otherwise(total)


def seeded(base: Column, seed: int) -> Column:
    """Hash of (string + seed's digits) from the string's own hash: the digits extend the polynomial."""
    digits = str(seed)
    tail = 0
    for c in digits:
        tail = tail * 31 + ord(c)
    power = pow(31, len(digits), 1 << 32)
    power -= (power >> 31) << 32
    h = wrap(wrap(base * power) + (tail & 0xFFFFFFFF))
    k = F.shiftright(wrap(h * FIRST), SHIFT_1)
    return F.abs(F.shiftright(wrap(k * SECOND), SHIFT_2)).cast("int")


def hash_seed(key: Column, seed: int) -> Column:
    return seeded(string_hash(key), seed)


def min_hash(hashes: Column, seed: int) -> Column:
    """The least seeded hash over an array of string hashes; null for an empty array, which matches nothing."""
    return F.array_min(F.transform(hashes, lambda h: seeded(h, seed)))


def jaccard_value(common: Column, union: Column) -> Column:
    """Similarity rounded to single precision (0.6 becomes a little more, 0.7 a little less); two empty sets: 1."""
    return F.when(union == 0, F.lit(1.0)).otherwise((common / union).cast("float").cast("double"))


def jaccard(a: Column, b: Column) -> Column:
    return jaccard_value(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def tokens(text: Column) -> Column:
    """Distinct words between single spaces and line breaks."""
    return F.array_distinct(F.filter(F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" ")), " "), lambda t: t != ""))
