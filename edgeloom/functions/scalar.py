"""Column expressions that stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of the published rational Chebyshev fit of erfc
#: (relative error below 1.2e-7 everywhere), constant term first.
ERFC = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]


def normal_two_sided(z: Column) -> Column:
    """P(|Z| >= |z|) of a standard normal: erfc(|z| / sqrt 2)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.5) * x)
    series = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        series = F.lit(c) + t * series
    return t * F.exp(-x * x + series)


def normal_upper(z: Column) -> Column:
    """P(Z >= z): the one-sided tail."""
    half = normal_two_sided(z) / 2
    return F.when(z >= 0, half).otherwise(1 - half)


def log2_ratio(observed: Column, expected: Column) -> Column:
    """log2 of observed over expected, both floored at 1."""
    return F.log2(F.greatest(observed.cast("double"), F.lit(1.0)) / F.greatest(expected, F.lit(1.0)))


def reverse_complement(sequence: Column) -> Column:
    return F.reverse(F.translate(F.upper(sequence), "ACGTN", "TGCAN"))


def count_base(sequence: Column, base: str) -> Column:
    return F.length(sequence) - F.length(F.translate(sequence, base, ""))


def low_complexity(sequence: Column, share: float = 0.8) -> Column:
    """True where one base makes up at least ``share`` of the sequence."""
    most = F.greatest(*[count_base(sequence, b) for b in "ACGT"])
    return most >= F.lit(share) * F.length(sequence)


def pack_two_bits(sequence: Column) -> Column:
    """A, C, G, T as 0..3, first base in the lowest bits; at most 31 bases in a long."""
    digits = F.translate(F.reverse(sequence), "ACGT", "0123")
    return F.conv(digits, 4, 10).cast("long")


def hamming(a: Column, b: Column, bases: int) -> Column:
    """Mismatches between two packed sequences of ``bases`` bases (2 bits each)."""
    differ = a.bitwiseXOR(b)
    low = F.lit(int("01" * bases, 2))
    return F.bit_count((differ.bitwiseOR(F.shiftright(differ, 1))).bitwiseAND(low))


def hamming_text(a: Column, b: Column) -> Column:
    """Mismatches between two strings of equal length; null otherwise."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    total = F.aggregate(pairs, F.lit(0), lambda s, x: s + x)
    return F.when(F.length(a) == F.length(b), total)


def unit_length(x: Column, y: Column, z: Column) -> list[Column]:
    """Coordinates on the unit sphere; the origin stays null."""
    norm = F.sqrt(x * x + y * y + z * z)
    return [F.when(norm > 0, c / norm) for c in (x, y, z)]


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def pack_bits(sequence: Column, alphabet: str, bits: int) -> Column:
    """Letters as numbers of ``bits`` bits each, first letter lowest; letters outside the alphabet
    count as its last. Fits 63 // bits letters."""
    code = lambda c: F.when(F.instr(F.lit(alphabet), c) > 0, F.instr(F.lit(alphabet), c) - 1).otherwise(len(alphabet) - 1)
    return F.aggregate(F.reverse(F.split(sequence, "")), F.lit(0).cast("long"), lambda s, c: s * (1 << bits) + code(c))


def unpack_bits(packed: Column, alphabet: str, bits: int, length: int) -> Column:
    letter = lambda i: F.substring(F.lit(alphabet), F.call_function("shiftright", packed, i * bits).bitwiseAND(F.lit((1 << bits) - 1)).cast("int") + 1, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(length - 1)), letter), "")


def parse_size(text: Column) -> Column:
    """A number with an optional K, M or G (thousands, millions, milliards); null where it is none."""
    value = F.regexp_extract(text, r"^(\d+(?:\.\d+)?)[KMGkmg]?$", 1)
    unit = F.upper(F.regexp_extract(text, r"([KMGkmg])$", 1))
    scale = F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "G", 1e9).otherwise(1.0)
    return F.when(value != "", value.cast("double") * scale)
