"""Random-coil shifts of sequences at given temperature, pH and ionic strength.

A residue sees its own letter and two on either side, so each residue row gets
its pentamer by ``substring``. Every table, bounded by the alphabet, is one
constant array indexed by the letter's code, folded at planning: no join, window
or shuffle. With the pKa of isolated sites the pH terms are such look-ups too.
Titrated sites come from the kernel as one array for each distinct (sequence,
temperature, ionic strength) and reach their rows by one join on these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coilworks.functions import coil_tables as ct
from coilworks.functions.chi import hill

SITES = "DEHCKRY"
FIRST, LAST = ord("A"), ord("n")  #: codes of the constant arrays; n and c stand for the ends of a chain
PH_LIMIT = 9.9  #: pH terms that reach it are left out


def _text(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, (list, tuple)):
        return f"array({','.join(map(_text, value))})"
    return f"{value!r}D" if isinstance(value, float) else repr(value)


def constant(values: dict[str, object], kind: str) -> Column:
    """A constant array of values of one SQL type, by letter code from FIRST on; null where a letter has none."""
    return F.expr(f"cast({_text([values.get(chr(c)) for c in range(FIRST, LAST + 1)])} as array<{kind}>)")


def by_letter(values: Column, letter: Column) -> Column:
    """The value of a letter, null outside the codes."""
    return F.get(values, F.ascii(letter) - FIRST)


def residues(seqs: DataFrame, *keep: str, ends: bool = False) -> DataFrame:
    """Inner residues of ``seq``: keep, pos (1-based), aa, m2, m1, p1, p2 with n and c beyond the ends.

    Sequences under 4 residues, null or empty give none. With ``ends`` every
    place from 0 (n) to L + 1 (c) of a sequence that is not empty.
    """
    padded = F.concat(F.lit("--n"), "seq", F.lit("c--"))
    span = F.sequence(F.lit(0), F.length("seq") + 1) if ends else F.sequence(F.lit(2), F.length("seq") - 1)
    rows = seqs.filter(F.length("seq") >= (1 if ends else 4)).select(*keep, padded.alias("_s"), F.explode(span).alias("pos"))
    at = lambda d: F.substring(F.col("_s"), F.col("pos") + 3 + d, F.lit(1))
    return rows.select(*keep, "pos", at(0).alias("aa"), at(-2).alias("m2"), at(-1).alias("m1"), at(1).alias("p1"), at(2).alias("p2"))


def residue_class(aa: Column) -> Column:
    return F.coalesce(by_letter(constant(ct.CLASSES, "string"), aa), F.lit("p"))


PLACES = ((2, "p2"), (1, "p1"), (-1, "m1"), (-2, "m2"))
KINDS = "GPra+-p"
_VECTOR = "array<double>"


def _kind(aa: Column) -> Column:
    """Place of the residue's class in KINDS."""
    return F.coalesce(by_letter(constant({aa: KINDS.index(k) for aa, k in ct.CLASSES.items()}, "int"), aa), F.lit(KINDS.index("p")))


def with_coefficients(rows: DataFrame, tables: ct.CoilTables) -> DataFrame:
    """Adds arrays over the atoms: _centre, _warm, and for each place _n<place> (neighbour) and _k<place> (pair)."""
    ends, nei, comb = ct.terminus(), tables.neighbour, tables.combination
    new = {
        "_centre": by_letter(constant({aa: [row[a] for a in ct.ATOMS] for aa, row in ct.centre().items()}, _VECTOR), F.col("aa")),
        "_warm": by_letter(constant({aa: [0.0 if a == "HB" else row[a] / 1000 for a in ct.ATOMS] for aa, row in ct.temperature().items()}, _VECTOR), F.col("aa")),
        "_kind": _kind(F.col("aa")),
    }
    pairs = {}
    for o, c in PLACES:
        values = {aa: [nei.get((a, aa, o), 0.0) for a in ct.ATOMS] for aa in ct.AMINO_ACIDS}
        if o == 2:
            values["c"] = [ends[a, "c"] for a in ct.ATOMS]
        if o == -2:
            values["n"] = [ends[a, "n"] for a in ct.ATOMS]
        new[f"_n{c}"] = by_letter(constant(values, _VECTOR), F.col(c))
        new[f"_kind{c}"] = _kind(F.col(c))
        known = {k[2:] for k in comb if k[1] == o}
        table = [[comb.get((a, o, x, y)) for a in ct.ATOMS] if (x, y) in known else None for x in KINDS for y in KINDS]
        p = KINDS.index("p")
        # (p, p) counts beside S and T only
        counts = (F.col("_kind") != p) | (F.col(f"_kind{c}") != p) | F.col("aa").isin("S", "T")
        pairs[f"_k{c}"] = F.when(counts, F.get(F.expr(f"cast({_text(table)} as array<{_VECTOR}>)"), F.col("_kind") * len(KINDS) + F.col(f"_kind{c}")))
    return rows.withColumns(new).withColumns(pairs)


def _of_places(prefix: str, i: Column) -> Column:
    total = F.lit(0.0)
    for _, c in PLACES:
        total = total + F.coalesce(F.get(f"_{prefix}{c}", i), F.lit(0.0))
    return total


def neighbour_correction(i: Column) -> Column:
    """Sum over the four neighbours for the atom at place ``i``; unknown residues count nothing, an end only where it belongs."""
    return _of_places("n", i)


def pair_correction(i: Column) -> Column:
    """Sum over matching (place, centre class, neighbour class)."""
    return _of_places("k", i)


def temperature_correction(i: Column) -> Column:
    """HB has none."""
    return F.coalesce(F.get("_warm", i) * (F.col("temperature") - 298), F.when((i == ct.ATOMS.index("HB")) | F.col("temperature").isNotNull(), 0.0))


def _at_ph7(i: Column) -> Column:
    return F.get("_centre", i) + neighbour_correction(i) + pair_correction(i) + temperature_correction(i)


def _long(rows: DataFrame, keep: tuple[str, ...], name: str, of_atom) -> DataFrame:
    """keep, pos, aa, atom, ``name`` for the atoms that have a value.

    One lambda over the atoms: seven copies of the sum make a method too large
    for the JVM to compile. The outer generator keeps the optimizer from testing
    the array a second time.
    """
    values = F.transform(F.sequence(F.lit(0), F.lit(len(ct.ATOMS) - 1)), of_atom)
    atoms = F.array(*[F.lit(a) for a in ct.ATOMS])
    return rows.select(*keep, "pos", "aa", values.alias("_v")).select(*keep, "pos", "aa", F.posexplode_outer("_v").alias("_i", name)).filter(F.col(name).isNotNull()).select(*keep, "pos", "aa", F.get(atoms, F.col("_i")).alias("atom"), name)


def shifts_at_ph7(rows: DataFrame, keep: tuple[str, ...], tables: ct.CoilTables) -> DataFrame:
    """keep, temperature, pos, aa, atom, shift for every inner standard residue; Gly CB and HB and Pro H do not exist."""
    keep = tuple(dict.fromkeys((*keep, "temperature")))
    return _long(with_coefficients(rows.filter(F.col("aa").isin(*ct.AMINO_ACIDS)), tables), keep, "shift", _at_ph7)


def _protonation(ph: Column, aa: str, pka: Column, n_h: Column) -> Column:
    """Fraction protonated at ``ph`` less that of the isolated site at pH 7."""
    return hill(ph, pka, n_h) - hill(F.lit(7.0), F.lit(ct.PK0[aa]), n_h)


def fixed_fractions(ph: Column) -> Column:
    """Array by letter code of the fractions of isolated sites with Hill coefficient 0.9."""
    places = {ord(aa): _protonation(ph, aa, F.lit(ct.PK0[aa]), F.lit(0.9)) for aa in SITES}
    return F.array(*[places.get(c, F.lit(None).cast("double")) for c in range(FIRST, ord("Z") + 1)])


def with_ph_coefficients(rows: DataFrame) -> DataFrame:
    """Adds arrays over the atoms of the pH shifts: _own, and _next and _last of the residues after and before."""
    table = ct.ph_shifts()
    look = lambda i, c: by_letter(constant({aa: [table[aa, a][i] for a in ct.ATOMS] for aa in SITES}, _VECTOR), F.col(c))
    return rows.withColumns({"_own": look(0, "aa"), "_next": look(1, "p1"), "_last": look(2, "m1")})


def ph_term(i: Column) -> Column:
    """What protonation of a residue and the two beside it adds to the shift of its atom ``i``; null if none of them does.

    Reads f0, fp and fm, the fractions of the residue, the next and the one before.
    """
    parts = [F.get(c, i) * F.col(f) for c, f in (("_own", "f0"), ("_next", "fp"), ("_last", "fm"))]
    return F.when(F.coalesce(*parts).isNotNull(), sum([F.coalesce(p, F.lit(0.0)) for p in parts[1:]], F.coalesce(parts[0], F.lit(0.0))))


def fixed_ph_terms(seqs: DataFrame, *keep: str) -> DataFrame:
    """keep, pos, atom, term at every place of ``seq`` and beside its ends, with the pKa of isolated sites."""
    rows = residues(seqs.select(*keep, "seq", fixed_fractions(F.col("ph")).alias("_f")), *keep, "_f", ends=True)
    rows = rows.select(*keep, "pos", "aa", "p1", "m1", *[by_letter(F.col("_f"), F.col(c)).alias(f) for c, f in (("aa", "f0"), ("p1", "fp"), ("m1", "fm"))])
    return _long(with_ph_coefficients(rows), keep, "term", ph_term).drop("aa")


def fixed_sites(seqs: DataFrame, *keep: str) -> DataFrame:
    """Ionisable residues with the pKa of an isolated site and Hill coefficient 0.9."""
    rows = seqs.select(*keep, F.posexplode(F.split("seq", "")).alias("p", "aa")).filter(F.col("aa").isin(*SITES))
    return rows.select(*keep, (F.col("p") + 1).alias("pos"), "aa", by_letter(constant({aa: ct.PK0[aa] for aa in SITES}, "double"), F.col("aa")).alias("pka"), F.lit(0.9).alias("n_h"))


def titrated_fractions(seqs: DataFrame) -> DataFrame:
    """``seqs`` with _f: an array by place (0-based in ``seq``) of the fractions of its titrated sites."""
    from coilworks.operators import pka

    sites = pka.titrated_chains(seqs)
    fraction = "1 - 1 / (pow(10D, n_h[i] * ({pk} - {ph})) + 1)"
    each = f"{fraction.format(pk='pka[i]', ph='ph')} - ({fraction.format(pk='pk0[i]', ph='7D')})"
    return seqs.join(sites, ["seq", "temperature", "ionic"], "left").withColumn("_f", F.expr(f"transform(sequence(0, size(pka) - 1), i -> {each})"))


def predict(seqs: DataFrame, key: str, tables: ct.CoilTables | None = None, fixed_pka: bool = False) -> DataFrame:
    """key, pos, aa, atom, shift of ``seqs`` (key, seq, temperature, ph, ionic).

    pH terms are left out at pH 7 exactly and where they reach PH_LIMIT. A row
    with a null temperature, pH or (if sites are titrated) ionic strength has no
    shifts; rows of one key are predicted each for itself.
    """
    tables = tables or ct.load_tables()
    seqs = seqs.select(key, "seq", "temperature", "ph", "ionic").dropna(subset=["seq", "temperature", "ph", *([] if fixed_pka else ["ionic"])])
    keep = (key, "temperature", "ph", "_f")
    if fixed_pka:
        rows = residues(seqs.withColumn("_f", fixed_fractions(F.col("ph"))), *keep)
        places = {f: by_letter(F.col("_f"), F.col(c)) for c, f in (("aa", "f0"), ("p1", "fp"), ("m1", "fm"))}
    else:
        rows = residues(titrated_fractions(seqs), *keep)
        places = {f: F.get("_f", F.col("pos") - 1 + d) for d, f in ((0, "f0"), (1, "fp"), (-1, "fm"))}
    rows = rows.filter(F.col("aa").isin(*ct.AMINO_ACIDS)).withColumns(places).drop("_f")
    rows = with_ph_coefficients(with_coefficients(rows, tables))

    def shift(i: Column) -> Column:
        term = ph_term(i)
        return _at_ph7(i) - F.coalesce(F.when((F.col("ph") != 7.0) & (F.abs(term) < PH_LIMIT), term), F.lit(0.0))

    return _long(rows, (key,), "shift", shift)
