"""Points in ranges by equality: every range is covered by aligned blocks of powers of two, of which a point meets one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sizes of blocks are 2^0 to 2^(LEVELS - 1), enough for every int.
LEVELS = 31


def covered(ranges: DataFrame, low: str, high: str) -> DataFrame:
    """ranges with (level, bin), one row per block: at most two of each size, none overlaps another, together [low, high].

    Ranges that end before they begin have no block; numbers are not below zero.
    """
    # Blocks of a size that lie within the range are lo to hi; of these, the ends whose double block does not lie in it.
    lo = f"bigint(ceil({low} / power(2, l)))"
    hi = f"(shiftright(bigint({high}) + 1, l) - 1)"
    ends = f"CASE WHEN {lo} <= {hi} THEN array_compact(array(CASE WHEN {lo} % 2 = 1 THEN {lo} END, CASE WHEN {hi} % 2 = 0 THEN {hi} END)) ELSE array() END"
    blocks = f"flatten(transform(sequence(0, {LEVELS}), l -> transform({ends}, b -> named_struct('level', l, 'bin', b))))"
    return ranges.filter(F.col(low) <= F.col(high)).select("*", F.inline(F.expr(blocks)))


def containing(points: DataFrame, ranges: DataFrame, key: str, point: str, low: str, high: str) -> DataFrame:
    """points (key, point) joined with all ranges of their key that contain them, low and high included.

    Both sides meet in (key, level, bin), so a key with most of the rows spreads over its blocks, and no pair is made
    that does not hold. Points look up sizes up to that of the largest block only.
    """
    blocks = covered(ranges, low, high)
    # The longest range bounds the sizes of its blocks; one value.
    top = ranges.agg(F.max(F.col(high) - F.col(low) + 1)).first()[0] or 0
    levels = max(int(top).bit_length(), 1)
    asked = points.select("*", F.explode(F.expr(f"transform(sequence(0, {levels - 1}), l -> named_struct('level', l, 'bin', shiftright(bigint({point}), l)))")).alias("b")).select(*points.columns, "b.*")
    return asked.join(blocks, [key, "level", "bin"]).drop("level", "bin")
