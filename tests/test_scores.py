import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from coilworks.functions.chi import p_score, z_score
from coilworks.operators import scoring
from coilworks.operators.pka import PH, fit, hill, titrate


def frame(spark, columns, n):
    rows = [("p", i + 1, 0, *[None if np.isnan(c[i]) else float(c[i]) for c in columns]) for i in range(n)]
    return spark.createDataFrame(rows, "pep string, pos int, leak int, " + ", ".join(f"x{j} double" for j in range(7)))


def test_known_limits_of_the_scores(spark):
    ks = [1, 2, 3, 7, 14, 21]
    df = spark.createDataFrame([(k, 16.0 * k) for k in ks], "k int, tot double")
    got = {r.k: (r.z, r.p) for r in df.select("k", z_score(F.col("tot"), F.col("k")).alias("z"), p_score(F.col("tot"), F.col("k")).alias("p")).collect()}
    for k, want in zip(ks, [3.876, 5.2, 6.263, 9.4, 13.212, 16.15]):
        assert got[k][0] == pytest.approx(want, abs=2e-3) and got[k][1] == pytest.approx(0, abs=1e-12)
    low = spark.createDataFrame([(1, 0.0), (7, 0.0), (0, 0.0)], "k int, tot double").select("k", z_score(F.col("tot"), F.col("k")).alias("z"), p_score(F.col("tot"), F.col("k")).alias("p")).collect()
    assert low[0].z == pytest.approx(-2.987, abs=1e-3) and low[1].z == pytest.approx(-9.107, abs=1e-3) and low[0].p == 1.0 and low[2].z is None and low[2].p is None


def test_rolling_and_offsets_match_pandas(spark):
    rng = np.random.default_rng(3)
    n = 60
    cols = [rng.normal(2.5 if j == 1 else 0, 1, n) for j in range(7)]
    for j in range(7):
        cols[j][rng.random(n) < 0.1] = np.nan
    cols[6][:] = np.nan
    got = scoring.running_offsets(frame(spark, cols, n)).orderBy("pos").toPandas()
    sds = {}
    for j in range(6):
        s = pd.Series(cols[j]).dropna()
        sds[j] = s.rolling(9, center=True).std(ddof=0).reindex(range(n))
        assert np.allclose(got[f"s{j}"].astype(float), sds[j], equal_nan=True)
    mean = pd.concat(sds.values(), axis=1).dropna().mean(axis=1)
    if len(mean):
        assert got.best_pos[0] == mean.idxmin() + 1
    assert got.o6.isna().all()


def test_degenerate_peptides(spark):
    nothing = [np.full(5, np.nan)] * 7
    r = scoring.corrected(frame(spark, nothing, 5)).toPandas()
    assert r.z3.isna().all() and r.p3.isna().all() and (r.off0 == 0).all()
    same = [np.full(12, 1.5)] * 7
    r = scoring.corrected(frame(spark, same, 12)).toPandas()
    assert (r.off0 == 1.5).all() and np.allclose(r.p3, 1.0)
    assert scoring.corrected(frame(spark, same, 12).limit(0)).count() == 0


def test_single_site_is_the_plain_hill_curve():
    (found,) = [s for s in titrate("AAADAAA", 298.0, 7.0) if s[1] == "D"]
    assert found[0] == 4 and abs(found[2] - 3.86) < 0.6
    pka, n = fit(hill(PH[None, :], np.array([[4.2], [13.7]]), np.array([[0.8], [0.9]])), np.array([3.86, 13.9]))
    assert np.allclose(pka, [4.2, 13.7], atol=1e-6) and np.allclose(n, [0.8, 0.9], atol=1e-6)


def test_titration_matches_enumeration():
    """Five sites or fewer share one window, so after the last cycle the exact partition sum holds."""
    from coilworks.functions.coil_tables import PK0
    from coilworks.operators.pka import coupling

    seq = "DAKE"
    chain = f"n{seq}c"
    at = [i for i, c in enumerate(chain) if c in PK0]
    pk = [PK0[chain[i]] for i in at]
    base = [-1.0 if chain[i] in "DEYc" else 0.0 for i in at]
    w = [[0.0 if i == j else float(coupling(np.array([abs(i - j)]), 298.0, 0.1)[0]) for j in at] for i in at]
    curves = np.zeros((len(at), len(PH)))
    for k, ph in enumerate(PH):
        total, part = 0.0, [0.0] * len(at)
        for state in range(2 ** len(at)):
            c = [(state >> i) & 1 for i in range(len(at))]
            g = sum(w[i][j] * c[i] * c[j] for i in range(len(at)) for j in range(len(at)))
            g += sum(c[i] * (2 * sum(w[i][j] * base[j] for j in range(len(at))) + ph - pk[i]) for i in range(len(at)))
            e = 10**-g
            total += e
            part = [p + e * ci for p, ci in zip(part, c)]
        curves[:, k] = [p / total for p in part]
    pka, n = fit(curves, np.array(pk))
    got = titrate(seq, 298.0, 0.1)
    assert np.allclose([g[2] for g in got], pka, atol=1e-6) and np.allclose([g[3] for g in got], n, atol=1e-6)
    assert math.isfinite(sum(pka))


def screened(d, ionic):
    """The published energy of two charges at distance d, without the factor of units."""
    x = math.sqrt(ionic) * d / (3.08 * math.sqrt(6))
    small = math.erfc(x)
    product = math.exp(x * x - math.log(79 * d) + math.log(small)) if small else 0.0
    return 332.286 * math.sqrt(6 / math.pi) * (1 / (79 * d) - math.sqrt(math.pi) * x * product)


def test_screened_energy_at_high_ionic_strength():
    from coilworks.operators.pka import coupling

    gaps = np.arange(1, 140)
    for ionic in (1e-4, 0.1, 3.0, 7.0):
        want = np.array([screened(5 + 7.5 * math.sqrt(g), ionic) * 4181.2 / (8.314472 * 298 * math.log(10)) / 2 for g in gaps])
        got = coupling(gaps, 298.0, ionic)
        # erfc has a few digits only in its last steps above 0
        x = np.sqrt(ionic) * (5 + 7.5 * np.sqrt(gaps)) / (3.08 * math.sqrt(6))
        coarse = (x > 26.4) & np.array([math.erfc(v) > 0 for v in x])
        assert np.allclose(got[~coarse], want[~coarse], rtol=1e-6, atol=1e-9) and np.allclose(got[coarse], want[coarse], atol=1e-4)
    high = coupling(gaps, 298.0, 7.0)
    assert (high[84:93] < 2.2e-5).all() and (high[84:93] > 1.8e-5).all() and (high[93:] > 0.02).all()
    smooth = coupling(gaps, 298.0, 7.0, exact=True)
    assert (np.diff(smooth) < 0).all() and np.allclose(smooth[:93], high[:93])


def test_titration_of_many_sites_matches_plain_loops():
    """Windows of five sites, the first cycle from the start values, the later ones in place; curves are compared at the fit."""
    pk0 = {"n": 8.23, "D": 3.86, "E": 4.34, "H": 6.45, "C": 8.49, "K": 10.34, "R": 13.9, "Y": 9.76, "c": 3.55}
    seq, temperature, ionic = "DAKEHGGCYRDDAKEKLH", 293.0, 0.05
    chain = f"n{seq}c"
    at = [i for i, c in enumerate(chain) if c in pk0]
    n = len(at)
    assert n >= 12
    base = [-1.0 if chain[i] in "DEYc" else 0.0 for i in at]
    w = [[0.0 if i == j else screened(5 + 7.5 * math.sqrt(abs(at[i] - at[j])), ionic) * 4181.2 / (8.314472 * temperature * math.log(10)) / 2 for j in range(n)] for i in range(n)]
    grid = [1.99 + 0.15 * k for k in range(54)]
    held = [[1 / (10 ** (0.9 * (ph - pk0[chain[i]])) + 1) for i in at] for ph in grid]
    for cycle in range(5):
        source = [row[:] for row in held] if cycle == 0 else held
        for s in range(n):
            lo = min(max(s - 2, 0), n - 5)
            win = range(lo, lo + 5)
            for k, ph in enumerate(grid):
                q = [(0.0 if j in win else source[k][j]) + base[j] for j in range(n)]
                diag = {i: 2 * sum(w[i][j] * q[j] for j in range(n)) + ph - pk0[chain[at[i]]] for i in win}
                part = total = 0.0
                for state in itertools.product((0, 1), repeat=5):
                    c = dict(zip(win, state))
                    e = 10 ** -(sum(diag[i] * c[i] for i in win) + sum(w[i][j] * c[i] * c[j] for i in win for j in win))
                    total += e
                    part += e * c[s]
                held[k][s] = part / total
    pka, slope = fit(np.array(held).T, np.array([pk0[chain[i]] for i in at]))
    got = titrate(seq, temperature, ionic)
    assert [g[0] for g in got] == at and "".join(g[1] for g in got) == "".join(chain[i] for i in at)
    assert np.allclose([g[2] for g in got], pka, atol=1e-6) and np.allclose([g[3] for g in got], slope, atol=1e-6)
    # the fit itself, by a plain search around its result
    for k in range(n):
        curve = np.array(held)[:, k]
        loss = lambda a, b: float(((1 / (np.power(10.0, b * (np.array(grid) - a)) + 1) - curve) ** 2).sum())
        best = loss(pka[k], slope[k])
        assert all(loss(pka[k] + da, slope[k] + db) >= best - 1e-12 for da in (-1e-3, 0, 1e-3) for db in (-1e-3, 0, 1e-3))
