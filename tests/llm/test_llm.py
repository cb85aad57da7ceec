import itertools
import random
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from coilworks.llm import canonical, grouping, leaks, lookalikes, mixing, nearby, overlap, residues, terms
from coilworks.llm.lookalikes import skeleton, words

AA = "ACDEFGHIKLMNPQRSTVWY"


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def mutated(rng, s, n):
    s = list(s)
    for _ in range(n):
        i = rng.randrange(len(s))
        kind = rng.randrange(3)
        if kind == 0:
            s[i] = rng.choice(AA)
        elif kind == 1 and len(s) > 1:
            del s[i]
        else:
            s.insert(i, rng.choice(AA))
    return "".join(s)


ENT = "ent_row bigint, entry_id string, entity_id string, polymer_type string, seq string, data_split string, feed string, split string, res string"
P = "polypeptide(L)"


def entities(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], ENT)


# --- problem 3


def test_overlaps_are_those_of_brute_force(spark):
    rng = random.Random(1)
    base = ["".join(rng.choice(AA) for _ in range(rng.choice([2, 6, 7, 12, 13, 20, 33, 47, 80, 120]))) for _ in range(40)]
    base += ["A" * 30, "A" * 30, "HHHHHHGSSGSSG" * 3]  # repeated segments
    rows, n = [], 0
    for b in base:
        for split in ("train", " Train", "val", "TEST", None):
            n += 1
            s = mutated(rng, b, rng.choice([0, 1, len(b) // 8, len(b) // 6 + 1]))
            rows.append((n, "e", str(n), P, s.lower() if n % 3 else f"{s[:5]} {s[5:]}*\n", split, "f"))
    rows += [(n + 1, "e", "x", "polydeoxyribonucleotide", base[0], "val", "f"), (n + 2, "e", "y", P, None, "val", "f"), (n + 3, "e", "z", P, "", "train", None), (n + 4, "e", "w", P, ".", "test", None)]
    clean = [(r[0], re.sub("[^A-Za-z]", "", r[4] or "").upper(), (r[5] or "").strip().lower()) for r in rows if r[3] == P]
    want = set()
    for a, b in itertools.combinations([c for c in clean if c[1] and c[2]], 2):
        if (a[2] == "train") != (b[2] == "train") and 100 * edit(a[1], b[1]) <= 15 * max(len(a[1]), len(b[1])):
            want.add((min(a[0], b[0]), max(a[0], b[0])))
    got = [tuple(r) for r in overlap.row_pairs(entities(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_one_segment_in_every_row(spark):
    """A tag at the start of all strings and a run within them: hot segments lose no pair."""
    rng = random.Random(12)
    rows = []
    for n in range(160):
        body = "".join(rng.choice(AA) for _ in range(rng.choice([30, 40, 60])))
        for split in ("train", "val"):
            s = "MGSSHHHHHHSSG" + mutated(rng, body[:15] + "AAAAAAAA" + body[15:], rng.randrange(7))
            rows.append((len(rows), "e", str(n), P, s, split, "f"))
    strings = [(r[0], r[4], r[5]) for r in rows]
    want = {(min(i, j), max(i, j)) for (i, a, s), (j, b, t) in itertools.combinations(strings, 2) if s != t and abs(len(a) - len(b)) <= 12 and 100 * edit(a, b) <= 15 * max(len(a), len(b))}
    e = entities(spark, rows)
    assert {tuple(r) for r in overlap.row_pairs(e).collect()} == want and len(want) >= 100
    of = {r.ent_row: r.sid for r in overlap.members(e).collect()}
    pairs = [(r.sid_e, r.sid_t) for r in overlap.representative_pairs(e).collect()]
    assert len(pairs) == len(set(pairs)) and {tuple(sorted((i, j))) for x, y in pairs for i in of for j in of if (of[i], of[j]) == (x, y) and rows[i][5] == "val" and rows[j][5] == "train"} == want


def test_strings_are_shuffled_in_pieces_and_nothing_is_broadcast(spark):
    """The join's volume follows the strings, groups are bounded, and the driver holds none of it; more pieces give the same pairs."""
    rng = random.Random(31)
    rows = []
    for n in range(150):
        body = "".join(rng.choice(AA) for _ in range(rng.choice([5, 30, 60, 110, 400])))
        rows += [(3 * n + j, "e", str(n), P, mutated(rng, body, rng.randrange(len(body) // 8 + 1)), split, "f") for j, split in enumerate(("train", "val", "train"))]
    e = entities(spark, rows)
    plan = overlap.row_pairs(e)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "Generate explode" not in plan
    kept = overlap.split_rows(e)
    strings = overlap.distinct_strings(kept)
    assert overlap.dealt(strings, 15, overlap.pieces(kept)).count() <= 4 * strings.count()
    few = overlap.pieces(kept, most=2000)
    assert max(t for t, _ in few.values()) > 2 and max(h for _, h in few.values()) > 2
    sizes = overlap.dealt(strings, 15, few).groupBy("band", "part_t", "part_e", "held").agg(F.sum(F.length("res")).alias("letters"))
    assert sizes.agg(F.max("letters")).first()[0] <= 3 * 2000
    whole, parts = (sorted((r.sid_e, r.sid_t, r.distance) for r in overlap.string_pairs(kept, most=m).collect()) for m in (overlap.PIECE, 2000))
    assert whole == parts and len(set(parts)) == len(parts) >= 200


@pytest.mark.parametrize("percent", [5, 15, 30])
def test_near_pairs_in_small_blocks(monkeypatch, percent):
    """Blocks of a few strings, segments and pairs lose none of the pairs of brute force."""
    for name, size in (("STEP", 3), ("STRINGS", 7), ("HITS", 11), ("BAGS", 5), ("PAIRS", 20)):
        monkeypatch.setattr(nearby, name, size)
    rng = random.Random(percent)
    base = ["".join(rng.choice("ACDEFG") for _ in range(rng.choice([1, 2, 5, 6, 9, 20, 41, 70, 300]))) for _ in range(25)] + ["A" * 40, "HHHHHHGSSGSSG" * 4]
    held, train = ([mutated(rng, b, rng.randrange(len(b) * percent // 100 + 2)) or "A" for b in base] for _ in range(2))
    got = {(int(i), int(j)) for e, t in nearby.near_pairs(nearby.Strings(pa.array(held)), nearby.Strings(pa.array(train)), percent) for i, j in zip(e, t)}
    want = {(i, j) for i, a in enumerate(held) for j, b in enumerate(train) if 100 * abs(len(a) - len(b)) <= percent * max(len(a), len(b)) and 100 * edit(a, b) <= percent * max(len(a), len(b))}
    assert want <= got and len(want) >= 5


def test_no_overlaps_in_an_empty_table(spark):
    assert overlap.row_pairs(entities(spark, [])).count() == 0
    c = overlap.overlap_counts(entities(spark, [(1, "e", "1", P, "ACDEFGHIKL", "val", "f"), (2, "e", "2", P, "ACDEFGHIKL", "train", "f"), (3, "e", "3", P, "WWWWWWWWWW", "val", "f")])).collect()
    assert [(r.eval_rows, r.overlapping_rows, r.exact_rows, r.pairs) for r in c] == [(2, 1, 1, 1)]


# --- problem 4


def components(edges, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_spanning_forest_of_random_graphs(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(200, 200 + i) for i in range(1, 30)] + [(5, 5), (100, 101), (101, 100)]
    labels, forest = grouping.spanning_forest(spark.createDataFrame(pairs, "u bigint, v bigint"))
    nodes = {n for p in pairs if p[0] != p[1] for n in p}
    want = components([p for p in pairs if p[0] != p[1]], nodes)
    got = {r.node: r.comp for r in labels.collect()}
    assert set(got) == nodes
    for a, b in itertools.combinations(sorted(nodes), 2):
        assert (got[a] == got[b]) == (want[a] == want[b])
    tree = [tuple(sorted(r)) for r in forest.collect()]
    assert len(set(tree)) == len(nodes) - len(set(want.values())) and components(tree, nodes) == want
    assert grouping.spanning_forest(spark.createDataFrame([], "u bigint, v bigint"))[0].count() == 0


def test_related_rows_and_splits(spark):
    rows = [(1, "a", "1", P, "AC DE", None, "f"), (2, "b", "1", P, "acde", None, "f"), (3, "b", "2", P, "WWW", None, "f"), (4, "c", "1", P, "YYY", None, "f"), (5, "d", "1", P, None, None, "f"), (6, "e", "1", P, "", None, "f"), (7, "f", "1", P, "KKK", None, "f"), (8, "g", "1", None, "ACDE", None, "f")]
    links = [("b", "2", " unp:q1 2.3"), ("c", "1", "Q12"), ("d", "1", "N/A"), ("e", "1", "n/a"), ("f", "1", None), ("f", "1", "PDB:pdb_1"), ("d", "1", "pdb _1"), ("a", "1", "Q12.7"), ("g", "1", "Q12")]
    e, k = entities(spark, rows), spark.createDataFrame(links, "entry_id string, entity_id string, accession_code string")
    got = {r.ent_row: r.group_row for r in grouping.related_rows(e, k).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 7: 5}
    targets = spark.createDataFrame([("train", 0.5, 1), ("val", 0.5, 2)], "data_split string, target_share double, rows int")
    a = grouping.assign_splits(e, k, targets).collect()
    assert len(a) == 7 and all(len({r.new_split for r in a if r.group_row == g}) == 1 for g in {r.group_row for r in a})
    assert grouping.split_report(grouping.assign_splits(e, k, targets), targets).count() == 2
    assert grouping.related_rows(entities(spark, []), k.limit(0)).count() == 0


def test_shares_are_met_with_skewed_groups(spark):
    rows = [(i, f"e{i}", "1", P, "ACDEFG" if i % 3 == 0 else AA[i % 20] * (5 + i // 40), None, "f") for i in range(900)]
    e = entities(spark, rows)
    targets = spark.createDataFrame([("train", 0.8), ("val", 0.1), ("test", 0.1)], "data_split string, target_share double")
    none = spark.createDataFrame([], "entry_id string, entity_id string, accession_code string")
    got = {r.data_split: r.share for r in grouping.split_report(grouping.assign_splits(e, none, targets), targets).collect()}
    assert abs(got["train"] - 0.8) < 0.03 and abs(got["val"] - 0.1) < 0.03 and abs(got["test"] - 0.1) < 0.03


@pytest.mark.parametrize("sizes", [[500, 200, 100] + [1] * 1200, [7] * 40, [1000], [2**k for k in range(11)], list(range(1, 90))])
def test_dealing_by_bands(sizes):
    """Each band goes whole, and shares miss their targets by no more than the groups force."""
    import math

    shares = [("test", 0.1), ("train", 0.8), ("val", 0.1)]
    totals = {}
    for s in sizes:
        n, r = totals.get(math.floor(math.log2(s) * grouping.BANDS), (0, 0))
        totals[math.floor(math.log2(s) * grouping.BANDS)] = (n + 1, r + s)
    got = {k: 0.0 for k, _ in shares}
    for band, (n, r) in totals.items():
        cuts = sorted((lo, hi, k) for b, lo, hi, k in grouping._deal(totals, shares) if b == band)
        assert cuts[0][0] == 0 and cuts[-1][1] == n and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:]))
        for lo, hi, k in cuts:
            got[k] += (hi - lo) * r / n
    assert all(abs(got[k] / sum(sizes) - s) <= max(0.02, max(sizes) / sum(sizes)) for k, s in shares)


def test_accessions(spark):
    df = spark.createDataFrame([("UNP: q0i3 ",), ("gb|YA1.2",), ("pdb_00a",), ("to be assigned",), ("-",), (None,), ("Q0 I3",)], "c string")
    assert [r[0] for r in df.select(residues.accession(F.col("c"))).collect()] == ["Q0I3", "YA1", "PDB_00A", None, None, None, "Q0I3"]


# --- problem 2


REF = [(1, "chemical", "urea", ["carbamide"]), (2, "chemical", "guanidinium chloride", ["GdmCl", "guanidine hydrochloride"]), (3, "chemical", "deuterated sodium acetate", ["sodium acetate-d3"]), (4, "chemical", "tris(2-carboxyethyl)phosphine", None), (5, "chemical", "(NH4)2SO4", []), (6, "keyword", "denatured", ["denaturant present"]), (7, "detail", "N-terminal hexahistidine tag", ["N-His6 tag"])]


def test_terms(spark):
    ref = spark.createDataFrame([(*r, "clash") for r in REF], "term_id bigint, kind string, term string, aliases array<string>, name string")
    chem = ["urea", " UREA; ", "uera", "8 M urea", "Ｃarbamide (50 mM)", "thiourea", "N-methylurea", "chloride, guanidinium", "guanidinium_chlorid", "gdmсl", "Na acetate-d3", "sodium butyrate", "tris(2-carboxyethyl)phosphine, 5 mM", "(NH4)2SO4", None, "", ".", "n/a", "None", "x" * 3000]
    want = [1, 1, 1, 1, 1, 0, 0, 2, 2, 2, 3, 0, 4, 5, 0]
    presets = spark.createDataFrame([(1, chem, ["Denatured protein", "denatur...", None, "renatured"]), (2, None, []), (3, ["urea", "urea"], None)], "preset_row bigint, chemical_denaturants array<string>, keywords_blacklist array<string>")
    ent = spark.createDataFrame([(1, "contains: N-term. hexahistidine tag, batch 4"), (2, None), (3, "-"), (4, "strep tag")], "ent_row bigint, details string")
    got = {(r.field_name, r.row_id, r.item_no): r.term_id for r in terms.canonical_terms(presets, ent, ref).collect()}
    at = [i + 1 for i, c in enumerate(chem) if c is not None and c.strip().lower() not in terms.NO_VALUE]
    assert [got["chemical_denaturants", 1, i] for i in at] == want
    assert [got["keywords_blacklist", 1, i] for i in (1, 2)] == [6, 6] and ("keywords_blacklist", 1, 3) not in got
    assert got["chemical_denaturants", 3, 2] == 1 and got["details", 1, 1] == 7 and got["details", 4, 1] == 0 and len(got) == len(at) + 2 + 3 + 2
    assert terms.canonical_terms(presets.limit(0), ent.limit(0), ref).count() == 0
    assert {r.term_id for r in terms.canonical_terms(presets, ent, ref.limit(0)).collect()} == {0}


def test_similar_names_of_other_things(spark):
    """Short names keep their letters, other stems and numbers are other things, additions are learned."""
    rows = [(1, "chemical", "urea", []), (2, "chemical", "2-mercaptoethanol", ["BME", "2-ME"]), (3, "chemical", "trip", []), (4, "chemical", "ethylene glycol", []), (5, "chemical", "polysorbate 20", []), (6, "chemical", "sodium azide", ["NaN3"]), (7, "chemical", "methanol", [])]
    ref = spark.createDataFrame(rows, "term_id bigint, kind string, term string, aliases array<string>")
    typed = {"pith urea": 0, "tris": 0, "trip": 3, "2-ME": 2, "2-me, 5 mM": 2, "3-ME": 0, "polyethylene glycol": 0, "Polysorbate 80": 0, "polysorbat 20": 5, "Na azide": 6, "mehtanol": 7, "buffered urea": 1, "azide sodium, buffered": 6, "glycol ethylene (buffered)": 4, "ethylene-glycol-(see-note)": 4, "buffered trip": 3, "buffered ethanediol": 0}
    presets = spark.createDataFrame([(1, list(typed), None)], "preset_row bigint, chemical_denaturants array<string>, keywords_blacklist array<string>")
    got = terms.canonical_terms(presets, spark.createDataFrame([], "ent_row bigint, details string"), ref).collect()
    assert {r.value: r.term_id for r in got} == typed


def test_similarity_join_is_exact(spark, monkeypatch):
    rng = random.Random(2)
    sets = lambda n: [("k" if i % 4 else "other", [str(i)], rng.sample(range(16), rng.randrange(1, 9))) for i in range(n)]
    a, b = sets(60), sets(50)
    make = lambda rows: spark.createDataFrame(rows, "kind string, bag array<string>, tokens array<bigint>")
    for t, most in ((0.4, 1 << 20), (0.5, -1), (0.6, 1 << 20)):
        monkeypatch.setattr(terms, "BROADCAST_BYTES", most)
        want = {(i[0], j[0]) for k, i, x in a for m, j, y in b if k == m and len(set(x) & set(y)) > t * len(set(x) | set(y)) + 1e-12}
        got = [(r.left_bag[0], r.right_bag[0]) for r in terms.similarity_join(make(a), make(b), t).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def pairs_of_letters(words):
    seen, out = {}, set()
    for w in words:
        p = f"^{w}$"
        for a, b in [(p[i], p[i + d]) for d in (1, 2) for i in range(len(p) - d)]:
            x = (min(a, b), max(a, b))
            seen[x] = seen.get(x, -1) + 1
            out.add((ord(x[0]) << 42) + (ord(x[1]) << 21) + seen[x])
    return out


def test_tokens_are_numbered_pairs(spark):
    bags = [["urea"], ["banana", "ana"], ["a"], ["βeta", "2", "x" * 500], ["12", "𝛽𝛽"]]
    for r in spark.createDataFrame([(b,) for b in bags], "bag array<string>").select("bag", terms.tokens("bag").alias("t")).collect():
        assert len(r.t) == len(set(r.t)) and set(r.t) == pairs_of_letters(r.bag)


@given(st.text(max_size=80))
@settings(max_examples=200)
def test_any_text_has_words(text):
    w = terms.words_of(text)
    assert w and isinstance(w, tuple)


# --- problem 6


def test_leaks_are_those_of_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(60)] + ["the", "of"] * 20
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([5, 14, 15, 16, 60, 100])))) for i in range(40)]
    docs = []
    for d in range(120):
        text = [rng.choice(vocab) for _ in range(rng.choice([0, 10, 40, 200]))]
        for _ in range(rng.randrange(3)):
            _, it = rng.choice(items)
            it = it.split()
            n = min(len(it), rng.choice([13, 14, 15, 16, 29, 30, 31, 60]))
            p = rng.randrange(len(it) - n + 1)
            q = rng.randrange(len(text) + 1)
            text[q:q] = it[p : p + n]
        joined = " ".join(text)
        docs.append((d, joined.upper().replace(" ", ",\n", 3) if d % 2 else joined.replace("w1", "ｗ1​"), "x"))
    docs += [(1000, None, "x"), (1001, "", "x"), (1002, "word " * 20000, "x"), (5, docs[5][1], "x")]
    items += [(900, None), (901, "")]
    runs = lambda w: {tuple(w[p : p + 15]) for p in range(len(w) - 14)}
    known = {i: runs(words(t or "")) for i, t in items}
    want = sorted((d, i) for d, t, _ in docs for i, k in known.items() if k & runs(words(t or "")))
    D = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string")
    I = spark.createDataFrame(items, "item_id bigint, item_text string")  # noqa: E741
    assert sorted(map(tuple, leaks.leaks(D, I).collect())) == want and want
    monkeypatch.setattr(leaks, "PIECE_WORDS", 300)
    monkeypatch.setattr(leaks, "PASS_BYTES", 20_000)  # several pieces and passes
    assert leaks.index_pieces(I).count() > 2 and len(list(leaks._passes(leaks.index_pieces(I)))) > 1
    assert sorted(map(tuple, leaks.leaks(D, I).collect())) == want
    assert leaks.leaks(D.limit(0), I).count() == 0 and leaks.leaks(D, I.limit(0)).count() == 0


def test_wand_finds_all_scores_above_the_thresholds(monkeypatch):
    """Against scores of all pairs, with blocks of two postings."""
    monkeypatch.setattr(leaks, "BLOCK", 2)
    rng = random.Random(7)
    vocab = ["the", "of", "and"] * 30 + [f"{a}{i}" for a in "abcdefgh" for i in range(12)]
    texts = [[rng.choice(vocab) for _ in range(rng.randrange(15, 50))] for _ in range(60)]
    idf = {w: rng.random() * 5 + 0.01 for t in texts for w in t}
    index = leaks.Index(list(range(60)), texts, idf, 30.0)
    order = index.ids
    docs = [texts[3][2:30] + ["unknown"] * 5 + texts[44][:15], [rng.choice(vocab) for _ in range(300)], ["x"] * 40, texts[9], [], ["the"] * 100]
    impact = {}
    for k, i in zip(index.key.tolist(), index.impact.tolist()):
        impact[divmod(k, 60)] = i
    want = set()
    for d, doc in enumerate(docs):
        for s in range(0, len(doc) - 14, 15):
            terms = {index.vocab[w] for w in doc[s : s + 30] if w in index.vocab}
            want |= {(d, s, j) for j in range(60) if sum(impact.get((t, j), 0.0) for t in terms) >= index.least[j]}
    read = [index.read(doc) for doc in docs]
    got = list(index.retrieve(read))
    assert len(got) == len(set(got)) and set(got) == want
    leaked = {(d, order[j]) for d, s, j in got if index.verify(read[d], s, j)}
    assert {(0, 3), (0, 44), (3, 9)} <= leaked


# --- problem 8


ALIKE = [("ﬁne µM Åsvik", "fine μM Åsvik"), ("café", "café"), ("ｐＨ　７", "pH 7"), ("a b", "a b"), ("co­il​", "coil"), ("Тhе соil", "The coil"), ("οver", "over"), ("сигнал", "cигнaл")]
DIFFERENT = [("café", "cafe"), ("pH 7", "pH 1"), ("coil", "Coil"), ("a  b", "a b"), ("Cα", "Ca"), ("x²", "x2"), ("a\nb", "a b"), ("Hβ", "Hß")]


@pytest.mark.parametrize("a,b", ALIKE)
def test_alike(a, b):
    assert skeleton(a) == skeleton(b)


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_different(a, b):
    assert skeleton(a) != skeleton(b)


@given(st.text(max_size=60))
def test_skeleton_is_stable(text):
    s = skeleton(text)
    assert skeleton(s) == s and canonical.canonical(canonical.canonical(text, {}), {}) == canonical.canonical(text, {})


def test_trie_finds_look_alikes_only():
    t = canonical.Trie()
    for w, n in (("сигнал", 9), ("cop", 1), ("сор", 5), ("naïve", 2), ("fine", 3)):
        t.add(w, n)
    assert {w for w, _, _ in t.look_up("cop")} == {"cop", "сор"} and canonical.choose(t.look_up("сoр"), "сoр") == "cop"
    assert canonical.choose(t.look_up("cигнaл"), "cигнaл") == "сигнал" and [w for w, _, _ in t.look_up("naï​ve")] == ["naïve"]
    assert t.look_up("naive") == [] and [w for w, _, _ in t.look_up("ﬁne")] == ["fine"]
    assert ("fine", 3, 1) in t.look_up("fime", 1) and ("fine", 3, 1) in t.look_up("fne", 1) and ("fine", 3, 1) in t.look_up("finer", 1)


def test_alike_pairs(spark, monkeypatch):
    docs = [(i, t) for i, t in enumerate([x for p in ALIKE for x in p] + [x for p in DIFFERENT for x in p] + ["coil", "coil", None, "", "", "​", "сигнал", "v" * 40000])]
    D = spark.createDataFrame([(i, t, "c", "w") for i, t in docs], "doc_id bigint, text string, canon string, _words string")
    want = sorted((i, j) for (i, a), (j, b) in itertools.combinations(docs, 2) if a is not None and b is not None and a != b and skeleton(a) == skeleton(b))
    assert sorted(map(tuple, canonical.alike_pairs(D).collect())) == want
    one = {r.doc_id: r.canon for r in canonical.normalize(D).collect()}
    monkeypatch.setattr(canonical, "BROADCAST_BYTES", -1)
    assert {r.doc_id: r.canon for r in canonical.normalize(D).collect()} == one
    assert one[15] == "сигнал" and len(one) == len(docs)
    assert canonical.alike_pairs(D.limit(0)).count() == 0


def test_the_vocabulary_decides(spark, monkeypatch):
    """A letter that may look Latin is read so only in a word that the corpus has; without vocabulary the pair is lost."""
    docs = ["the kinase acts", "the \u043ainase acts", "the Hα shift", "the Ha shift", "a \u03bd\u0435ctor", "a vector", "\u03bdolt", "Δν band", "Δv band", "xk\u0431", "type Ⅳ", "type IV"]
    D = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    assert sorted(map(tuple, canonical.alike_pairs(D).collect())) == [(0, 1), (4, 5), (10, 11)]
    empty = spark.createDataFrame([], "word string, canon string")
    monkeypatch.setattr(canonical, "dictionary", lambda documents: empty)
    assert sorted(map(tuple, canonical.alike_pairs(D).collect())) == [(10, 11)]


# --- problem 7


def corpus(spark, rows):
    return spark.createDataFrame([(i, s, t, 1, 2) for i, (s, t) in enumerate(rows)], "doc_id bigint, source string, text string, tokens int, copies int")


def test_mix_meets_shares_and_caps(spark):
    rng = random.Random(8)
    rows = [("Big ", "word " * rng.randrange(1, 80)) for _ in range(3000)] + [("small-one", "other text here " * rng.randrange(1, 20)) for _ in range(150)] + [("rest", "no")] * 5 + [(None, "x"), ("big", None), ("big", "")]
    targets = spark.createDataFrame([("big", 0.7, 1, 3), ("small_one", 0.3, 4, 3)], "source string, target_share double, max_repeats int, tokens int")
    D = corpus(spark, rows)
    m = mixing.mix(D, targets)
    r = {x.source: x for x in mixing.mix_report(m, targets).collect()}
    assert abs(r["big"].share - 0.7) < 0.005 and r["small_one"].most_copies == 4 and r["big"].most_copies == 1
    assert mixing.expand(m).groupBy("source").agg(F.sum("tokens").alias("t")).filter("source = 'big'").collect()[0].t == r["big"].tokens
    # a larger budget contains a smaller one
    few, more = ({x.doc_id for x in mixing.mix(D, targets, n).filter("source = 'big'").collect()} for n in (10_000, 20_000))
    assert few < more
    over = {x.source: x for x in mixing.mix_report(mixing.mix(D, targets, 10**9), targets).collect()}
    assert over["small_one"].most_copies == 4 and over["big"].documents == 3001
    assert mixing.mix(D.limit(0), targets).count() == 0 and mixing.mix(D, targets.limit(0)).count() == 0


def test_thresholds_find_the_budget(spark):
    rng = random.Random(9)
    docs = [("s", rng.randrange(1, 50), rng.randrange(1 << mixing.HASH_BITS)) for _ in range(2000)] + [("t", 5, 77)] * 10
    df = spark.createDataFrame(docs, "source string, tokens bigint, h bigint")
    edge = mixing.thresholds(df, {"s": 12_345.0, "t": 20.0})
    taken = sum(t for s, t, h in docs if s == "s" and h < edge["s"])
    assert 0 <= 12_345 - taken <= 50
    assert sum(t for s, t, h in docs if s == "t" and h < edge["t"]) == 0  # ties fall together, on the near side


def test_public_tokenizer(spark):
    df = spark.createDataFrame([("Hello world",), ("",), (None,), ("a" * 5000,)], "t string")
    got = [r[0] for r in df.select(mixing.token_count(F.col("t"))).collect()]
    assert got[0] == 2 and got[1] == 0 and got[2] is None and got[3] > 0


def test_entry_points_hold_the_columns():
    from coilworks.llm import queries

    assert {f"p{n}_found" for n in (2, 3, 4, 6, 8)} <= set(queries.QUERIES) and "p7_mix" in queries.QUERIES and lookalikes.CYRILLIC
