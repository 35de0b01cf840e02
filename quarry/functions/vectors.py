"""Vectors as bytes and texts as vectors, by built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import tokenize_query

#: Numbers of a vector that encode() makes of a text.
WIDTH = 64


def _turned(digits: str) -> str:
    """SQL for eight hexadecimal digits with their bytes in the opposite order."""
    return f"concat(substr({digits}, 7, 2), substr({digits}, 5, 2), substr({digits}, 3, 2), substr({digits}, 1, 2))"


def to_blob(vector: str) -> Column:
    """The bytes of an array of single floats, by column name: their number and then each, little-endian, 32 bits each.

    The bits of a number come from its sign, its power of two and what is left, which doubles hold exactly; not-a-number
    has one form. Null arrays and arrays with nulls give null.
    """
    a = "abs(double(x))"
    power = f"CASE WHEN {a} < power(2D, -126) THEN -126 ELSE bigint(floor(log2({a}))) + CASE WHEN {a} >= power(2D, floor(log2({a})) + 1) THEN 1 WHEN {a} < power(2D, floor(log2({a}))) THEN -1 ELSE 0 END END"
    normal = f"transform(array({power}), e -> bigint({a} / power(2D, e) * 8388608) + (e + 126) * 8388608)[0]"
    low = f"CASE WHEN isnan(x) THEN 2143289344 WHEN {a} = double('Infinity') THEN 2139095040 WHEN {a} = 0 THEN 0 ELSE {normal} END"
    sign = "CASE WHEN NOT isnan(x) AND startswith(string(x), '-') THEN 2147483648 ELSE 0 END"
    each = f"transform({vector}, x -> transform(array(lpad(hex({low} + {sign}), 8, '0')), h -> {_turned('h')})[0])"
    count = f"transform(array(lpad(hex(size({vector})), 8, '0')), h -> {_turned('h')})[0]"
    return F.expr(f"CASE WHEN {vector} IS NOT NULL AND NOT exists({vector}, x -> x IS NULL) THEN unhex(concat({count}, array_join({each}, ''))) END")


def from_blob(blob: str) -> Column:
    """(vector, error) of such bytes, by column name: an error where there are fewer than four or not as many as they say."""
    word = lambda k: f"bigint(conv({_turned(f'substr(hex({blob}), {k}, 8)')}, 16, 10))"
    bits = word("8 * k + 9")
    fraction, power = "b % 8388608", "b div 8388608 % 256"
    value = (
        f"CASE WHEN {power} = 255 THEN CASE WHEN {fraction} = 0 THEN float('Infinity') ELSE float('NaN') END "
        f"WHEN {power} = 0 THEN float({fraction} * power(2D, -149)) ELSE float((8388608 + {fraction}) * power(2D, {power} - 150)) END"
    )
    signed = f"CASE WHEN b >= 2147483648 THEN -({value}) ELSE {value} END"
    count = word("1")
    vector = f"transform(CASE WHEN {count} = 0 THEN array() ELSE sequence(0, int({count}) - 1) END, k -> transform(array({bits}), b -> {signed})[0])"
    size = f"octet_length({blob})"
    error = f"CASE WHEN {size} < 4 THEN concat('blob too short: ', {size}, ' bytes') WHEN {size} <> 4 + 4 * {count} THEN concat('blob length mismatch: ', {count}, ' elements in ', {size}, ' bytes') END"
    return F.struct(F.expr(f"CASE WHEN ({error}) IS NULL AND {blob} IS NOT NULL THEN {vector} END").cast("array<float>").alias("vector"), F.expr(error).alias("error"))


def encode(text: Column, width: int = WIDTH) -> Column:
    """A text as ``width`` numbers: each of its distinct tokens adds or takes one at a place, both decided by its digest.

    Texts with tokens in common lean the same way; a text without tokens is all zeros.
    """
    codes = F.transform(tokenize_query(text), lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long"))
    one = lambda c, d: F.when(F.floor(c / 2) % width == d, F.when(c % 2 == 0, 1.0).otherwise(-1.0)).otherwise(0.0)
    sums = lambda held: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda d: F.aggregate(held, F.lit(0.0), lambda s, c: s + one(c, d)))
    return F.transform(F.array(codes), sums)[0]
