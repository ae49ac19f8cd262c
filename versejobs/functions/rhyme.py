"""Rhyme scores in whole units, so that no engine's rounding matters.

Syllables score in hundredths; lines and songs in ten-thousandths.
"""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as T
from .phonetics import constants, last_codes

#: Weights of the last, second and third last syllable, in tenths.
WEIGHTS = (10, 5, 3)


def syllable_score(a: Column, b: Column) -> Column:
    """R1, in hundredths: vowels alike 80 or similar 64, codas alike 20 or of one group 14."""
    va, vb, ca, cb = F.floor(a / 32).cast("int"), F.floor(b / 32).cast("int"), a % 32, b % 32
    vowel = F.when(va == vb, 80).when(F.get(constants(T.SIMILAR), va) == vb, 64).otherwise(0)
    group = F.get(constants(T.GROUP), ca) == F.get(constants(T.GROUP), cb)
    return vowel + F.when(ca == cb, 20).when((ca > 0) & (cb > 0) & group, 14).otherwise(0)


def tail_score(a: Column, b: Column) -> Column:
    """R2, in ten-thousandths, of two lines' last codes (the last first)."""
    n = F.least(F.size(a), F.size(b))
    parts = [F.when(n > k, syllable_score(F.get(a, k), F.get(b, k)) * w).otherwise(0) for k, w in enumerate(WEIGHTS)]
    whole = F.when(n == 1, WEIGHTS[0]).when(n == 2, sum(WEIGHTS[:2])).otherwise(sum(WEIGHTS))
    return F.when(n > 0, F.floor(((parts[0] + parts[1] + parts[2]) * 200 + whole) / (whole * 2))).otherwise(0).cast("long")


def pair_scores(tails: Column) -> Column:
    """Scores of neighbouring lines from the array of their last codes."""
    n = F.size(tails)
    return F.when(n >= 2, F.zip_with(F.slice(tails, 1, n - 1), F.slice(tails, 2, n - 1), tail_score)).otherwise(F.array().cast("array<bigint>"))


def mean_score(scores: Column) -> Column:
    """R4, in ten-thousandths, rounded half up; 0 without pairs."""
    total, n = F.aggregate(scores, F.lit(0).cast("long"), lambda x, y: x + y), F.size(scores)
    return F.when(n > 0, F.floor((total * 2 + n) / (n * 2))).otherwise(0).cast("long")


def tails(lines: Column, known: Callable[[Column], Column] | None = None) -> Column:
    """The last codes of each line; `known` as in last_codes()."""
    return F.transform(lines, lambda x: last_codes(x, known))
