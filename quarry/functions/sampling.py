"""Token sampling in columns: a 64-bit generator, penalty, cut to the best k, and a draw by running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the xorshift64* generator: the shifts, the factor, and the state that stands for seed 0.
SHIFTS = (12, 25, 27)
FACTOR = 0x2545F4914F6CDD1D
STATE_OF_ZERO = 0x9E3779B97F4A7C15


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def seeded(seed: Column) -> Column:
    """The state for a seed."""
    return F.when(seed == 0, F.lit(signed(STATE_OF_ZERO))).otherwise(seed.cast("long"))


def next_state(state: Column) -> Column:
    """The state after one more draw."""
    a, b, c = SHIFTS
    state = state.bitwiseXOR(F.shiftrightunsigned(state, a))
    state = state.bitwiseXOR(F.shiftleft(state, b))
    return state.bitwiseXOR(F.shiftrightunsigned(state, c))


def uniform(state: Column) -> Column:
    """A draw from 0 up to 1 of 24 bits: the upper bits of the state times the factor, modulo 2^64.

    A column's product must not overflow, so it is multiplied out by digits of 16 bits, four of them.
    """
    mask = 0xFFFF
    part = lambda k: F.shiftrightunsigned(state, 16 * k).bitwiseAND(F.lit(mask))
    low = [FACTOR >> 16 * k & mask for k in range(4)]
    digits, carry = [], F.lit(0).cast("long")
    for k in range(4):
        total = carry
        for i in range(k + 1):
            total = total + part(i) * F.lit(low[k - i])
        digits.append(total.bitwiseAND(F.lit(mask)))
        carry = F.shiftrightunsigned(total, 16)
    top = digits[3] * 256 + F.shiftrightunsigned(digits[2], 8)
    return top.cast("double") / (1 << 24)


def penalised(logits: str, recent: str, penalty: float, window: int) -> str:
    """SQL: logits with those of the last ``window`` of ``recent`` ids made less likely, once for each time an id stands there; ids outside are skipped."""
    last = f"slice({recent}, greatest(size({recent}) - {window} + 1, 1), {window})"
    times = f"size(filter({last}, t -> t = i))"
    return f"transform({logits}, (z, i) -> if(z > 0, z / pow({penalty}D, {times}), z * pow({penalty}D, {times})))"


def sampled(rows: DataFrame, k: int, penalty: float, window: int) -> DataFrame:
    """rows (logits, recent, temperature, r: a draw) with id, from 0.

    Of temperature 0 or less it is the first greatest logit after the penalty; else the first id at which the running sum of the weights
    passes r times their sum, over the ``k`` greatest logits and those equal to the least of them (0: all).
    """
    cut = f"coalesce(get(sort_array(__z, false), {k - 1}), array_min(__z))" if k else "array_min(__z)"
    rows = rows.withColumn("__z", F.expr(penalised("logits", "recent", penalty, window)))
    rows = rows.withColumn("__top", F.expr("array_max(__z)")).withColumn("__cut", F.expr(cut))
    rows = rows.withColumn("__w", F.expr("transform(__z, z -> if(z >= __cut, exp((z - __top) / if(temperature > 0, temperature, 1D)), 0D))"))
    rows = rows.withColumn("__goal", F.expr("r * aggregate(__w, 0D, (a, w) -> a + w)"))
    passed = "aggregate(__w, struct(0D as acc, 0 as i, cast(null as int) as hit), (s, w) -> struct(s.acc + w as acc, s.i + 1 as i, coalesce(s.hit, if(__goal < s.acc + w, s.i, null)) as hit), s -> s.hit)"
    first = "cast(array_position(__z, __top) - 1 as int)"
    return rows.withColumn("id", F.expr(f"if(temperature > 0, coalesce({passed}, {first}), {first})")).drop("__z", "__top", "__cut", "__w", "__goal")
