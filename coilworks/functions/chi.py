"""Column expressions of the scores: chi-square transform, rescaled mean, Hill curve."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: atom columns in order, and the deviation expected of each
ATOMS = ("C", "CA", "CB", "HA", "H", "N", "HB")
WEIGHTS = {"C": 0.1846, "CA": 0.1982, "CB": 0.1544, "HA": 0.02631, "H": 0.06708, "N": 0.4722, "HB": 0.02154}
CAP = 4.0


def z_score(tot: Column, k: Column) -> Column:
    """Near-normal transform of a chi-square sum over k cells; null for k = 0."""
    q = tot / k
    top = F.pow(q, F.lit(1 / 6)) - F.pow(q, F.lit(1 / 3)) / 2 + F.sqrt(q) / 3 - (F.lit(5 / 6) - 1 / (9 * k) - 7 / (648 * k * k) + 25 / (2187 * k * k * k))
    return F.when(k > 0, top / F.sqrt(1 / (18 * k) + 1 / (162 * k * k) - 37 / (11664 * k * k * k)))


def p_score(tot: Column, k: Column) -> Column:
    """Geometric mean of the cells' normal densities, from [exp(-2), 1] to [0, 1]; null for k = 0."""
    floor = F.exp(F.lit(-2.0))
    return F.when(k > 0, (F.exp(-tot / (8 * k)) - floor) / (1 - floor))


def hill(ph: Column, pka: Column, n: Column) -> Column:
    return 1 - 1 / (F.pow(F.lit(10.0), n * (pka - ph)) + 1)


def rounded(x: Column, digits: int = 6) -> Column:
    """Half-even at the scaled value, as array rounding does it."""
    return F.rint(x * 10**digits) / 10**digits
