"""Hash expressions that stay inside the JVM: string residues, affine families, bit patterns."""

from __future__ import annotations

import random

from pyspark.sql import Column
from pyspark.sql import functions as F

# One fold step takes six bytes, so step * modulus stays far below 2**63.
_STEP_HEX_DIGITS = 12
_STEP_VALUE = 1 << 48

# Multipliers and modulus of the position hash (a Mersenne prime and two odd constants below it).
POSITION_PRIME = 2147483647
POSITION_MUL_1 = 48271
POSITION_MUL_2 = 69621


def affine_family(n: int, seed: int, a_max: int = 100001, b_max: int = 100000) -> list[tuple[int, int, int]]:
    """``n`` rows (hash_no, a, b) drawn from a seeded generator, 1 <= a <= a_max and 0 <= b <= b_max."""
    rng = random.Random(seed)
    return [(j, rng.randint(1, a_max), rng.randint(0, b_max)) for j in range(n)]


def family_rows(family: list[tuple[int, int, int]]) -> Column:
    """The family as a constant array of structs, to be exploded next to each row (no join needed)."""
    as_long = [
        F.struct(F.lit(j).cast("int").alias("hash_no"), F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b"))
        for j, a, b in family
    ]
    return F.array(*as_long)


def string_residue(text: Column, modulus: int) -> Column:
    """The UTF-8 bytes of ``text`` read as one big-endian integer, modulo ``modulus`` (below 2**31).

    Left-padding the hex digits with zeros to whole six-byte steps does not change the integer, so a short id
    takes a single step.
    """
    digits = F.hex(F.encode(text, "UTF-8"))
    steps = F.ceil(F.length(digits) / _STEP_HEX_DIGITS).cast("int")
    padded = F.lpad(digits, steps * _STEP_HEX_DIGITS, "0")
    shift = _STEP_VALUE % modulus

    def fold(acc: Column, step: Column) -> Column:
        chunk = F.conv(F.substring(padded, step * _STEP_HEX_DIGITS + 1, F.lit(_STEP_HEX_DIGITS)), 16, 10)
        return (acc * F.lit(shift).cast("bigint") + chunk.cast("bigint")) % F.lit(modulus).cast("bigint")

    folded = F.aggregate(F.sequence(F.lit(0), steps - 1), F.lit(0).cast("bigint"), fold)
    return F.when(text.isNull(), None).when(F.length(digits) == 0, F.lit(0).cast("bigint")).otherwise(folded)


def text_number(text: Column) -> Column:
    """A number in [0, 2**31-1) from the first 32 bits of the MD5 of a text."""
    return F.conv(F.substring(F.md5(F.encode(text, "UTF-8")), 1, 8), 16, 10).cast("bigint") % F.lit(POSITION_PRIME).cast("bigint")


def affine(x: Column, a: Column, b: Column, modulus: int) -> Column:
    return (a * x + b) % F.lit(modulus).cast("bigint")


def trailing_zeros(v: Column, zero_value: int = 10) -> Column:
    """Number of trailing zero bits of a non-negative bigint; a zero value counts as ``zero_value``."""
    return F.when(v == 0, F.lit(zero_value)).otherwise(F.bit_count(v.bitwiseXOR(v - 1)) - 1)


def position_hash(n: Column, seed: int) -> Column:
    """A well-mixed value in [0, 2**31-1) of a sequence number, by modular multiply and square steps."""
    p = F.lit(POSITION_PRIME).cast("bigint")
    high = F.floor(n / F.lit(POSITION_PRIME)).cast("bigint")
    h = (n % p * POSITION_MUL_1 + high * POSITION_MUL_2 + F.lit(seed).cast("bigint") * 16807 + 12345) % p
    h = (h * h + POSITION_MUL_2) % p
    h = (h * POSITION_MUL_1 + n % p) % p
    h = (h * h + POSITION_MUL_1) % p
    return (h * POSITION_MUL_2 + 1) % p
