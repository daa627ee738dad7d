"""Column functions: reproducible draws, byte-wise lower case, word tests, number words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def draw(key: Column) -> Column:
    """A reproducible draw from 0 to 2^32 - 1 that depends on ``key`` alone, not on partitions."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def one_decimal(x: Column) -> Column:
    """One decimal, rounded correctly from the binary value: 31.25 is 31.2."""
    return F.format_number(x, "0.0")


def lower_ascii(text: Column) -> Column:
    """Only A-Z change; the Kelvin sign doesn't become a k."""
    return F.translate(text, UPPER, LOWER)


def has_word(text: Column, word: str, digits_bound: bool = False) -> Column:
    """Whether a word stands alone: letters beside it never do, and digits only if ``digits_bound``."""
    edge = "a-z0-9" if digits_bound else "a-z"
    return F.regexp_like(lower_ascii(text), F.lit(f"(?<![{edge}]){re.escape(word)}(?![{edge}])"))


def numbers_grounded(expected: Column, reply: Column) -> Column:
    """Whether every number of ``expected`` is a substring of ``reply``; 3 is found in 36."""
    return F.forall(F.regexp_extract_all(expected, F.lit(r"-?[0-9]+(\.[0-9]+)?"), F.lit(0)), lambda n: F.contains(reply, n))


def clean_line(text: Column) -> Column:
    """Lower case without one leading number or bullet and without quotes around."""
    bare = F.regexp_replace(F.lower(F.trim(text)), r"^([0-9]+[.)]|[-*•])\s*", "")
    return F.btrim(bare, F.lit(" \"'"))


UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()


def spoken(n: int) -> list[str]:
    """The ways to say n, which is below 200."""
    if n < 20:
        return [UNITS[n]]
    if n < 100:
        ten, unit = TENS[n // 10 - 2], n % 10
        return [ten] if not unit else [f"{ten} {UNITS[unit]}", f"{ten}-{UNITS[unit]}"]
    rest = [""] if n == 100 else [f"{join} {w}" for w in spoken(n - 100) for join in (" and", "")]
    return [f"{one} hundred{r}".replace("  ", " ") for one in ("one", "a") for r in rest]


def number_words_to_digits():
    """A vectorised function that writes spoken numbers from 0 to 199 as digits.  Spark's regexp_replace takes no callback."""
    table = {w: str(n) for n in range(200) for w in spoken(n)}
    pattern = re.compile(r"(?<![A-Za-z])(" + "|".join(sorted(map(re.escape, table), key=len, reverse=True)) + r")(?![A-Za-z])")

    @F.pandas_udf("string")
    def replace(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: pattern.sub(lambda m: table[m[1]], t), na_action="ignore")

    return replace
