"""Titration of interacting sites: pKa and Hill coefficient of each ionisable residue.

The one numeric kernel that column expressions cannot hold. It runs in Arrow
batches over distinct (sequence, temperature, ionic strength), so copies of a
sequence, however many, are titrated once; sites are fitted together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from coilworks.functions.coil_tables import PK0
from coilworks.session import spread

# fixed values: gas constant, permittivity, chain distance d = A + B sqrt(separation), window half width, cycles
GAS, PERMITTIVITY, A, B, HALF, CYCLES = 8.314472, 79.0, 5.0, 7.5, 2, 5
PH = np.arange(1.99, 10, 0.15)
NEGATIVE = frozenset("DEYc")


@lru_cache(maxsize=None)
def _states(n: int) -> np.ndarray:
    """All 2^n protonation vectors."""
    return ((np.arange(2**n)[:, None] >> np.arange(n)[::-1]) & 1).astype(float)


def coupling(separation: np.ndarray, temperature: float, ionic: float, exact: bool = False) -> np.ndarray:
    """Half the pair energy in pH units of two sites so many residues apart.

    As published, erfc underflows to 0 beyond x = 26.5 and the energy jumps to
    that of no screening; ``exact`` has no jump. Just before, where exp(x^2)
    overflows or erfc has lost its digits, the product's asymptote is taken.
    """
    d = A + B * np.sqrt(separation)
    x = np.sqrt(ionic) * d / (3.08 * math.sqrt(6.0))

    def scaled(v: float) -> float:
        small = math.erfc(v)
        if v > 25 and (exact or small):
            return (1 - 1 / (2 * v**2) + 3 / (4 * v**4) - 15 / (8 * v**6)) / (v * math.sqrt(math.pi))
        return math.exp(v * v) * small if small else 0.0

    screened = np.array([scaled(v) for v in x])
    energy = 332.286 * math.sqrt(6 / math.pi) * (1 - math.sqrt(math.pi) * x * screened) / (PERMITTIVITY * d)
    return energy * 4181.2 / (GAS * temperature * math.log(10)) / 2


def hill(ph: np.ndarray, pka: np.ndarray, n: np.ndarray) -> np.ndarray:
    return 1 / (np.power(10.0, np.clip(n * (ph - pka), -300, 300)) + 1)


def fit(curves: np.ndarray, start: np.ndarray, steps: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """(pKa, n) of the Hill curve nearest to each row, by damped Gauss-Newton on all rows at once."""
    pka, n = start.astype(float).copy(), np.full(len(start), 0.9)
    damp = np.full(len(start), 1e-3)
    f = hill(PH[None, :], pka[:, None], n[:, None])
    loss = ((f - curves) ** 2).sum(1)
    for _ in range(steps):
        slope = f * (1 - f) * math.log(10)
        jp, jn = slope * n[:, None], -slope * (PH[None, :] - pka[:, None])
        r = curves - f
        a, b, c = (jp * jp).sum(1), (jp * jn).sum(1), (jn * jn).sum(1)
        u, v = (jp * r).sum(1), (jn * r).sum(1)
        ad, cd = a * (1 + damp) + 1e-300, c * (1 + damp) + 1e-300
        det = ad * cd - b * b
        det = np.where(np.abs(det) < 1e-300, 1e-300, det)
        dp, dn = np.clip((cd * u - b * v) / det, -2, 2), np.clip((ad * v - b * u) / det, -0.5, 0.5)
        f2 = hill(PH[None, :], (pka + dp)[:, None], (n + dn)[:, None])
        loss2 = ((f2 - curves) ** 2).sum(1)
        good = loss2 <= loss
        done = good & (np.abs(dp) < 1e-10) & (np.abs(dn) < 1e-10)
        pka, n = np.where(good, pka + dp, pka), np.where(good, n + dn, n)
        f, loss = np.where(good[:, None], f2, f), np.where(good, loss2, loss)
        damp = np.where(good, damp / 5, np.minimum(damp * 5, 1e12))
        if np.all(done | (damp >= 1e12)):
            break
    return pka, n


def titrate(seq: str, temperature: float, ionic: float, exact: bool = False) -> list[tuple[int, str, float, float]]:
    """(pos, site, pKa, n): pos is 1-based in ``seq``; n (0) and c (L+1) are the ends."""
    chain = f"n{seq}c"
    at = [i for i, c in enumerate(chain) if c in PK0]
    names = [chain[i] for i in at]
    size = len(at)
    pk0 = np.array([PK0[c] for c in names])
    base = np.array([-1.0 if c in NEGATIVE else 0.0 for c in names])
    place = np.array(at)
    gaps = np.abs(place[:, None] - place[None, :])
    per_gap = np.zeros(int(gaps.max()) + 1)
    used = np.unique(gaps[gaps > 0])
    if len(used):
        per_gap[used] = coupling(used, temperature, max(ionic, 1e-4), exact)
    ww = per_gap[gaps]
    start = hill(PH[:, None], pk0[None, :], 0.9)  # (pH, site) protonated fraction
    curve = start.copy()
    width = min(2 * HALF + 1, size)
    states = _states(width)
    pairs = states[:, :, None] * states[:, None, :]
    flat = pairs.reshape(len(states), -1)
    for cycle in range(CYCLES):
        held = start if cycle == 0 else curve  # the first cycle looks at the start only
        new = np.empty_like(curve) if cycle == 0 else curve
        charge = held + base[None, :]
        for i in range(size):
            lo = min(max(i - HALF, 0), size - width)
            win = slice(lo, lo + width)
            if cycle:
                charge = held + base[None, :]
            outside = charge.copy()
            outside[:, win] = base[win]
            g = np.broadcast_to(ww[win, win], (len(PH), width, width)).copy()
            diag = 2 * outside @ ww[win].T + PH[:, None] - pk0[win][None, :]
            idx = np.arange(width)
            g[:, idx, idx] = diag
            e = np.power(10.0, np.clip(-(g.reshape(len(PH), -1) @ flat.T), -300, 300))
            new[:, i] = e[:, states[:, i - lo] == 1].sum(1) / e.sum(1)
        curve = new
    pka, n = fit(curve.T, pk0)
    return [(p, c, float(a), float(b)) for p, c, a, b in zip(at, names, pka, n)]


_OUT = "seq string, temperature double, ionic double"


def _each_chain(conditions: DataFrame, result: str, of_chain) -> DataFrame:
    """``of_chain`` (rows of a chain) for each distinct row of seq, temperature, ionic without nulls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(s, t, i, *row) for s, t, i in zip(pdf.seq, pdf.temperature, pdf.ionic) for row in of_chain(s, t, i)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in f"{_OUT}, {result}".split(", ")])

    distinct = conditions.select("seq", "temperature", "ionic").filter("seq <> '' and temperature > 0 and ionic >= 0").distinct()
    return spread(distinct).mapInPandas(run, f"{_OUT}, {result}")


def titrations(conditions: DataFrame, exact: bool = False) -> DataFrame:
    """seq, temperature, ionic, pos, aa, pka, n_h of every site, ends included."""
    return _each_chain(conditions, "pos int, aa string, pka double, n_h double", lambda s, t, i: titrate(s, t, i, exact))


def titrated_chains(conditions: DataFrame, exact: bool = False) -> DataFrame:
    """seq, temperature, ionic and arrays as long as ``seq``: pka, n_h and pk0 of its residues, null where no site is."""

    def of_chain(seq: str, temperature: float, ionic: float):
        arrays = [[None] * len(seq) for _ in range(3)]
        for pos, aa, pka, n_h in titrate(seq, temperature, ionic, exact):
            if 1 <= pos <= len(seq):
                for array, value in zip(arrays, (pka, n_h, PK0[aa])):
                    array[pos - 1] = value
        return [arrays]

    return _each_chain(conditions, "pka array<double>, n_h array<double>, pk0 array<double>", of_chain)
