"""Coefficients of the random-coil predictor.

The centre, terminus, temperature and pH tables are fixed values of the published
predictor. The neighbour table (560 values) and the pair table (247 rows) are
parameters: CSV files ``neighbour.csv`` (atom, aa, p2, p1, m1, m2) and
``combination.csv`` (atom, neipos, centre, neighbour, value) in the folder that
COILWORKS_COIL_TABLES or the caller names. Without them ``load_tables`` stops with
an error; ``rule_tables`` gives tables made by a rule, which only the tests and
the registered queries use.
"""

from __future__ import annotations

import csv
import os
from typing import NamedTuple

AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"
THREE_TO_ONE = dict(zip("ALA CYS ASP GLU PHE GLY HIS ILE LYS LEU MET ASN PRO GLN ARG SER THR VAL TRP TYR".split(), AMINO_ACIDS, strict=True))
ATOMS = ("C", "CA", "CB", "N", "H", "HA", "HB")
PAIR_ROWS = 247  #: rows of the pair table
OFFSETS = (2, 1, -1, -2)  #: place of the neighbour in the columns of the neighbour table

# fixed values: shift of the centre residue by atom
CENTRE = """
aa C CA CB N H HA HB
A 177.44069  52.53002  19.21113 125.40155   8.20964   4.25629   1.31544
C 174.33917  58.48976  28.06269 120.71212   8.29429   4.44261   2.85425
D 176.02114  54.23920  41.18408 121.75726   8.28460   4.54836   2.60054
E 176.19215  56.50755  30.30204 122.31578   8.35949   4.22124   1.92383
F 175.42280  57.64849  39.55984 121.30500   8.10906   4.57507   3.00036
G 173.83294  45.23929  None     110.09074   8.32746   3.91016   None
H 175.00142  56.20256  30.60335 120.69141   8.27133   4.55872   3.03080
I 175.88231  61.04925  38.68742 122.37586   8.06407   4.10574   1.78617
K 176.22644  56.29413  33.02478 122.71282   8.24902   4.25873   1.71982
L 177.06101  55.17464  42.29215 123.48611   8.14330   4.28545   1.54067
M 175.90708  55.50643  32.83806 121.54592   8.24848   4.41483   1.97585
N 174.94152  53.22822  38.87465 119.92746   8.37189   4.64308   2.72756
P 176.67709  63.05232  32.03750 137.40612   None      4.36183   2.03318
Q 175.63494  55.79861  29.44174 121.49225   8.30042   4.28006   1.97653
R 175.92194  56.06785  30.81298 122.40365   8.26453   4.28372   1.73437
S 174.31005  58.36048  63.82367 117.11419   8.25730   4.40101   3.80956
T 174.27772  61.86928  69.80612 115.48126   8.11378   4.28923   4.15465
V 175.80621  62.20156  32.77934 121.71912   8.06572   4.05841   1.99302
W 175.92744  57.23836  29.56502 122.10991   7.97816   4.61061   3.18540
Y 175.49651  57.82427  38.76184 121.43652   8.05749   4.51123   2.91782
"""

# fixed values: correction beside the amino (n, at -2) and the carboxy end (c, at +2)
TERMINUS = """
C n -0.15238
C c -0.90166
CB n 0.12064
CB c 0.06854
CA n -0.04616
CA c -0.06680
N n 0.347176
N c 0.619141
H n 0.156786
H c 0.023189
HB n 0.0052692
HB c 0.0310875
HA n 0.048624
HA c 0.042019
"""

# fixed values: temperature coefficients, per 1000 K from 298 K
TEMPERATURE = """
aa  CA   CB   C     N    H    HA
A  -2.2  4.7 -7.1  -5.3 -9.0  0.7
C  -0.9  1.3 -2.6  -8.2 -7.0  0.0
D   2.8  6.5 -4.8  -3.9 -6.2 -0.1
E   0.9  4.6 -4.9  -3.7 -6.5  0.3
F  -4.7  2.4 -6.9 -11.2 -7.5  0.4
G   3.3  0.0 -3.2  -6.2 -9.1  0.0
H   7.8 15.5  3.1   3.3 -7.8  0.4
I  -2.0  4.6 -8.7 -12.7 -7.8  0.4
K  -0.8  2.4 -7.1  -7.6 -7.5  0.4
L   1.7  4.9 -8.2  -2.9 -7.5  0.1
M   4.1  9.4 -8.2  -6.2 -7.1 -0.5
N   2.8  5.1 -6.1  -3.3 -7.0 -2.9
P   1.1 -0.2 -4.0   0.0  0.0  0.0
Q   2.3  3.6 -5.7  -6.5 -7.2  0.3
R  -1.4  3.5 -6.9  -5.3 -7.1  0.4
S  -1.7  4.4 -4.7  -3.8 -7.6  0.1
T   0.0  2.2 -5.2  -6.7 -7.3  0.0
V  -2.8  2.5 -8.1 -14.2 -7.6  0.5
W  -2.7  3.1 -7.9 -10.1 -7.8  0.4
Y  -5.0  2.9 -7.7 -12.0 -7.7  0.5
"""

# fixed values: change of backbone shifts on deprotonation: own residue, then the residues before and after
PH_SHIFTS = """
D H  -0.17 0.02 -0.03
D HA -0.17 0.01 -0.01
D HB -0.23
D CA 1.4 0.0 0.1
D CB 3.0
D C  1.1 -0.2 0.4
D N  1.5  0.3 0.1
E H  0.12 0.00 0.02
E HA -0.10 0.01 0.00
E HB -0.06
E CA 1.0 0.0 0.0
E CB 1.5
E C  0.6  0.1 0.1
E N  1.0  0.2 0.1
H H  -0.2  -0.01  0.0
H HA -0.2  -0.01 -0.06
H HB -0.17
H CA 1.6 -0.1 0.1
H CB 2.4
H C 1.5  0.0 0.6
H N 1.8  0.3 0.5
C H 0.0
C HA -0.28 -0.01 -0.01
C HB -0.09
C CA 2.1 0.0 0.1
C CB 1.7
C C 1.9 -0.4 0.5
C N 3.6  0.4 0.6
Y H  0.0
Y HA -0.06
Y HB -0.08
Y CA 0.3
Y CB 0.1
Y C 0.4
Y N 0.6
K H  0.0
K HA -0.04
K HB -0.08
K CA 0.4
K CB 0.3
K C 0.5
K N 0.7
R H  0.0
R HA -0.07
R HB 0.05
R CA 0.2
R CB 0.9
R C 0.2
R N 0.4
"""

# fixed values: pKa of an isolated site
PK0 = {"n": 8.23, "D": 3.86, "E": 4.34, "H": 6.45, "C": 8.49, "K": 10.34, "R": 13.9, "Y": 9.76, "c": 3.55}

# fixed values: residue classes of the pair table; any other residue is p
CLASSES = {"G": "G", "P": "P", "F": "r", "Y": "r", "W": "r", "L": "a", "I": "a", "V": "a", "M": "a", "C": "a", "A": "a", "K": "+", "R": "+", "D": "-", "E": "-"}


def _table(text: str) -> dict[str, dict[str, float | None]]:
    head, *rows = [line.split() for line in text.strip().splitlines()]
    return {r[0]: {a: None if v == "None" else float(v) for a, v in zip(head[1:], r[1:], strict=True)} for r in rows}


def centre() -> dict[str, dict[str, float | None]]:
    return _table(CENTRE)


def temperature() -> dict[str, dict[str, float | None]]:
    return _table(TEMPERATURE)


def terminus() -> dict[tuple[str, str], float]:
    return {(a, t): float(v) for a, t, v in (line.split() for line in TERMINUS.strip().splitlines())}


def ph_shifts() -> dict[tuple[str, str], tuple[float, float | None, float | None]]:
    out = {}
    for aa, atom, own, *rest in (line.split() for line in PH_SHIFTS.strip().splitlines()):
        before, after = (map(float, rest)) if rest else (None, None)
        out[aa, atom] = (float(own), before, after)
    return out


class CoilTables(NamedTuple):
    neighbour: dict[tuple[str, str, int], float]  #: (atom, aa, offset) -> value
    combination: dict[tuple[str, int, str, str], float]  #: (atom, offset, centre class, neighbour class) -> value


def rule_tables() -> CoilTables:
    """Tables made by a rule, in the shape of the published ones; not measured values."""
    nei = {(a, aa, o): ((ord(aa) * 7 + i * 13 + j * 5) % 41 - 20) / 100 for i, a in enumerate(ATOMS) for aa in AMINO_ACIDS for j, o in enumerate(OFFSETS)}
    kinds = "GPra+-p"
    comb = {}
    for i, a in enumerate(ATOMS):
        for o in (-2, -1, 1, 2):
            for x, c in enumerate(kinds):
                for y, n in enumerate(kinds):
                    if (x * 3 + y * 5 + o * 7 + i * 11) % 5 == 0:
                        comb[a, o, c, n] = ((x * 3 + y * 5 + o * 7 + i * 11) % 31 - 15) / 50
    return CoilTables(nei, comb)


def load_tables(folder: str | None = None) -> CoilTables:
    """The neighbour and pair tables of a folder; an unnamed folder is an error, a wrong table too."""
    folder = folder or os.environ.get("COILWORKS_COIL_TABLES")
    if not folder:
        raise ValueError("name the folder of neighbour.csv and combination.csv (COILWORKS_COIL_TABLES), or pass rule_tables()")
    with open(os.path.join(folder, "neighbour.csv"), newline="") as f:
        nei = {(r["atom"], r["aa"], o): float(r[c]) for r in csv.DictReader(f) for o, c in zip(OFFSETS, ("p2", "p1", "m1", "m2"))}
    with open(os.path.join(folder, "combination.csv"), newline="") as f:
        rows = [((r["atom"], int(r["neipos"]), r["centre"], r["neighbour"]), float(r["value"])) for r in csv.DictReader(f)]
    if len({k for k, _ in rows}) != len(rows):
        raise ValueError("combination.csv has repeated keys")
    if set(nei) != {(a, aa, o) for a in ATOMS for aa in AMINO_ACIDS for o in OFFSETS}:
        raise ValueError(f"neighbour.csv needs one row for each of {len(ATOMS)} atoms and {len(AMINO_ACIDS)} residues")
    if len(rows) != PAIR_ROWS or any(a not in ATOMS or o not in OFFSETS or not {x, y} <= set("GPra+-p") for (a, o, x, y), _ in rows):
        raise ValueError(f"combination.csv needs {PAIR_ROWS} rows of known atoms, places and classes")
    return CoilTables(nei, dict(rows))
