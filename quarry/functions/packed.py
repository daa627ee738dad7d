"""Four-bit values in groups: two to a byte, the lower one first, each plus eight; one scale a group."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GROUP = 32


def pack(values: str) -> Column:
    """Bytes of an array of integers from -7 to 7; a last value without a partner goes with zero."""
    low, high = f"({values}[2 * i] + 8)", f"(coalesce(get({values}, 2 * i + 1), 0) + 8)"
    return F.expr(f"transform(filter(sequence(0, (size({values}) + 1) div 2), i -> i < (size({values}) + 1) div 2), i -> cast({low} | shiftleft({high}, 4) as int))")


def dot(packed: str, scales: str, x: str, group: int = GROUP) -> Column:
    """The product of a packed row (bytes of all groups, one after the other) with a vector: unpacked by shifts within the fold, scaled once a group.

    A group has ``group`` values, the last one what is left.
    """
    half = group // 2
    part = f"slice({packed}, g * {half} + 1, {half})"
    nibble = lambda shift: f"(({part}[i] >> {shift} & 15) - 8)" if shift else f"(({part}[i] & 15) - 8)"
    at = f"g * {group} + 2 * i"
    inner = f"aggregate(sequence(0, size({part}) - 1), 0D, (s, i) -> s + {nibble(0)} * {x}[{at}] + {nibble(4)} * coalesce(get({x}, {at} + 1), 0D))"
    return F.expr(f"aggregate(sequence(0, size({scales}) - 1), 0D, (t, g) -> t + {scales}[g] * {inner})")
