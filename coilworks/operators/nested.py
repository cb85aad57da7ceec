"""Nested deposition records to related flat tables (problem 1).

A payload is JSON text whose nesting, container shapes and key spelling differ
from tool to tool. It is parsed once into VARIANT, every container (list, single
object, object keyed by id, ``tags``/``data`` columns, JSON kept as text,
saveframes) is brought to one array form by a single typed cast of its objects,
and nested ``transform`` calls attach the ancestors' keys and 1-based places. ``flatten`` joins the arrays, and one
``inline`` for each target table emits rows. There is no shuffle, no join and no
Python: the whole operator is a projection behind the scan, so it scales with
the input and no record, however hot its entry, is brought together with others.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The parts of each kind of object; a part marked ``*`` is itself a container.
SHAPES = {
    "entry": ["entry_id", "assemblies*", "entities*", "saveframes*"],
    "assembly": ["id", "name", "details", "components*"],
    "component": ["id", "entity_ref", "label", "state", "entity*"],
    "entity": ["id", "name", "details", "type", "polymer_type", "seq", "links*"],
    "link": ["code", "accession", "mol_code", "identity"],
}
_TWICE = "spark.sql.variant.allowDuplicateKeys"
NODE_FIELDS = ("entry_id", "node_kind", "parent_id", "node_id", "ref_id")

#: Spellings under which each part of a record is written, all read.
KEYS = {
    "wrapper": ["entries", "entry", "data"],
    "entry_id": ["entry_id", "Entry_ID", "entryId", "ID", "id"],
    "assemblies": ["assemblies", "Assemblies", "assembly_list", "Assembly_list", "assembly", "Assembly"],
    "entities": ["entities", "Entities", "entity_list", "Entity_list"],
    "components": ["entities", "Entities", "entity_assembly", "Entity_assembly", "components", "Components"],
    "links": ["db_links", "DB_links", "Db_links", "entity_db_link", "Entity_db_link", "links"],
    "id": ["ID", "id", "Id"],
    "name": ["Name", "name"],
    "details": ["Details", "details"],
    "type": ["Type", "type"],
    "polymer_type": ["Polymer_type", "polymer_type"],
    "seq": ["Polymer_seq_one_letter_code", "polymer_seq_one_letter_code"],
    "entity": ["entity", "Entity"],
    "saveframes": ["saveframes", "Saveframes"],
    "entity_ref": ["Entity_ID", "entity_id", "Entity_id"],
    "label": ["Entity_label", "entity_label"],
    "state": ["Physical_state", "physical_state"],
    "code": ["Database_code", "database_code"],
    "accession": ["Accession_code", "accession_code"],
    "mol_code": ["Entry_mol_code", "entry_mol_code"],
    "identity": ["Seq_identity", "seq_identity"],
}


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once (``get`` would compute it twice)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _parsed(text: Column) -> Column:
    """JSON text as VARIANT, null unless the whole text is one JSON value.

    The bare parser stops after the first value; inside brackets anything after
    it is an error or a second element.
    """
    whole = F.try_variant_get(F.try_parse_json(F.concat(F.lit('[{"v":'), text, F.lit("}]"))), "$", "array<struct<v:variant>>")
    return _let(whole, lambda w: F.when(F.size(w) == 1, F.try_element_at(w, F.lit(1))["v"]))


def _is_object(v: Column) -> Column:
    """Cheap test: a cast to a struct without known fields keeps nothing of the object."""
    return F.try_variant_get(v, "$", "struct<_:string>").isNotNull()


def _is_list(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<struct<_:string>>").isNotNull()


def _unwrap(v: Column) -> Column:
    """A value kept as JSON text inside JSON is parsed once more."""
    return _let(v, lambda v: F.when(_is_object(v) | _is_list(v), v).otherwise(_parsed(F.try_variant_get(v, "$", "string"))))


def _clean(text: Column) -> Column:
    """Missing, null and ``.`` are ``''``."""
    return _let(F.trim(text), lambda x: F.when(x.isNull() | (x == "."), "").otherwise(x))


def _first_container(found: list[Column]) -> Column:
    return F.try_element_at(F.filter(F.array(*found), lambda x: x.isNotNull() & ~F.is_variant_null(x)), F.lit(1))


def _tidy(shape: str, text, container, key: Column) -> Column:
    """A struct of the shape's parts; ``text`` and ``container`` look one spelling up."""
    fields = []
    for part in SHAPES[shape]:
        name, nested = part.rstrip("*"), part.endswith("*")
        if nested:
            fields.append(_first_container([container(name, i) for i in range(len(KEYS[name]))]).alias(name))
        else:
            value = _clean(F.coalesce(*[text(name, i) for i in range(len(KEYS[name]))]))
            if name == "id":
                value = _let(value, lambda own: F.when(own != "", own).otherwise(_clean(key)))
            fields.append(value.alias(name))
    return F.struct(*fields)


def _cast_types(shape: str) -> tuple[str, str]:
    """The struct to cast an object to, and the same with names that differ in more than case."""
    spelled, plain = [], []
    for part in SHAPES[shape]:
        name, kind = part.rstrip("*"), "variant" if part.endswith("*") else "string"
        for i, k in enumerate(KEYS[name]):
            spelled.append(f"{k}:{kind}")
            plain.append(f"{name}_{i}:{kind}")
    return f"struct<{','.join(spelled)}>", f"struct<{','.join(plain)}>"


def _items(container: Column, shape: str) -> Column:
    """Any container as an array of the shape's structs, in order; anything else is an empty array."""
    spelled, plain = _cast_types(shape)
    raw = f"array<struct<k:string,x:{plain}>>"

    def cast(v: Column, around: str) -> Column:
        return F.try_variant_get(v, "$", around % spelled)

    def of_row(m: Column) -> Column:
        return F.struct(*[m[k].cast("variant" if part.endswith("*") else "string").alias(k) for part in SHAPES[shape] for k in KEYS[part.rstrip("*")]])

    def one(x: Column, key: Column) -> Column:
        return F.struct(key, x)

    def plainly(v: Column) -> Column:
        no_key = F.lit(None).cast("string")
        table = F.try_variant_get(v, "$", "struct<tags:array<string>,data:array<array<string>>>")
        listed = F.transform(F.filter(cast(v, "array<%s>"), lambda x: x.isNotNull()), lambda x: one(x, no_key))
        columnar = _let(table, lambda t: F.when(t["tags"].isNotNull() & t["data"].isNotNull(), F.transform(_rows(t, of_row), lambda x: one(x, no_key))))
        keyed = _let(cast(v, "map<string,%s>"), lambda m: F.when((F.size(m) > 0) & F.forall(F.map_values(m), lambda x: x.isNotNull()), F.transform(F.map_entries(m), lambda e: one(e["value"], e["key"]))))
        single = F.when(F.size(F.try_variant_get(v, "$", "map<string,string>")) > 0, F.array(one(cast(v, "%s"), no_key)))
        return F.coalesce(listed.cast(raw), columnar.cast(raw), keyed.cast(raw), single.cast(raw), F.array().cast(raw))

    found = F.coalesce(_let(_unwrap(container), plainly), F.array().cast(raw))
    return F.transform(found, lambda e: _tidy(shape, lambda name, i: e["x"][f"{name}_{i}"], lambda name, i: e["x"][f"{name}_{i}"], e["k"]))


def _rows(table: Column, of_row) -> Column:
    """Rows of a ``tags``/``data`` table; what is beyond the shorter of tags and row has no name or no value."""
    width = lambda r: F.least(F.size(table["tags"]), F.size(r))
    return F.transform(table["data"], lambda r: _let(F.map_from_arrays(F.slice(table["tags"], 1, width(r)), F.slice(r, 1, width(r))), of_row))


_FRAMES = "array<struct<category:string,tags:array<array<string>>,loops:array<struct<category:string,tags:array<string>,data:array<array<string>>>>>>"


def _framed(frames: Column, shape: str, category: str, loop: str, inner: str, inner_name: str) -> Column:
    """Objects of one saveframe category with the rows of their loop."""
    no_key = F.lit(None).cast("string")

    def of_row(m: Column) -> Column:
        look = lambda name, i: m[KEYS[name][i]]
        return _tidy(inner, look, lambda name, i: look(name, i).cast("variant"), no_key)

    def of_frame(f: Column) -> Column:
        tags = F.map_from_entries(F.transform(F.filter(f["tags"], lambda p: F.size(p) >= 2), lambda p: F.struct(F.element_at(p, 1), F.element_at(p, 2))))
        loops = F.filter(f["loops"], lambda x: F.lower(x["category"]) == loop)
        rows = F.flatten(F.transform(loops, lambda x: _rows(x, of_row)))
        plain = lambda m: _tidy(shape, lambda name, i: m[KEYS[name][i]], lambda name, i: m[KEYS[name][i]].cast("variant"), no_key)
        return _let(tags, plain).dropFields(inner_name).withField(inner_name, rows)

    return F.transform(F.filter(frames, lambda f: F.lower(f["category"]) == category), of_frame)


def normalized(df: DataFrame, keep: tuple[str, ...] = ("record_id",)) -> DataFrame:
    """Each readable record with arrays of its assemblies, components, entities and links.

    Columns: ``keep``, ``assemblies``, ``components``, ``entities``, ``links``;
    every element carries the entry id, its place and its ancestors' ids.
    Unreadable, null and empty payloads give no row; a record with no part has
    empty arrays. A node without an id keeps ``''`` (a component its place), equal
    nodes keep their own places. Other columns of ``df`` are not read, whatever
    their names.
    """
    steps = _steps(df.sparkSession.sparkContext)
    # of a key written twice the last value counts; the parsers take the setting when they are analyzed
    conf = df.sparkSession.conf
    before = conf.get(_TWICE)
    conf.set(_TWICE, "true")
    try:
        for name in ("root", "top", "raw", "e"):
            df = df.select(*keep, steps[name].alias(f"_{name}"))
        for name in ("cmp", "ent"):
            df = df.select("*", steps[name].alias(f"_{name}"))
    finally:
        conf.set(_TWICE, before)
    return df.filter(F.col("_e").isNotNull()).select(*keep, *[steps[n].alias(n) for n in ("assemblies", "components", "entities", "links")])


@lru_cache(maxsize=1)
def _steps(context) -> dict[str, Column]:
    """The expressions of :func:`normalized`, the same for all data: built once for a Spark context."""
    root = _let(_parsed(F.col("payload")), _unwrap)

    # wrappers around the entry: data, entry, entries, bare lists
    wrapper = "struct<entries:variant,entry:variant,data:variant>"

    def as_list(v: Column) -> Column:
        return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))

    def unpack(v: Column) -> Column:
        inner = _let(F.try_variant_get(v, "$", wrapper), lambda w: _first_container([w["entries"], w["entry"], w["data"]]))
        return _let(inner, lambda x: F.when(x.isNull(), F.array(v)).otherwise(as_list(x)))

    level = lambda arr: F.flatten(F.transform(arr, unpack))
    top = F.when(F.col("_root").isNotNull(), as_list(F.col("_root")))
    spelled, plain = _cast_types("entry")

    def entry(v: Column) -> Column:
        x = F.try_variant_get(v, "$", spelled).cast(plain)
        return _let(x, lambda x: F.when(x.isNotNull(), _tidy("entry", lambda n, i: x[f"{n}_{i}"], lambda n, i: x[f"{n}_{i}"], F.lit(None).cast("string"))))

    raw = F.filter(F.transform(level(level(level(F.col("_top")))), entry), lambda e: e.isNotNull())

    def parts_of(e: Column, i: Column) -> Column:
        frames = F.try_variant_get(e["saveframes"], "$", _FRAMES)
        asm = F.transform(_items(e["assemblies"], "assembly"), lambda a: a.withField("components", _items(a["components"], "component")))
        ent = F.transform(_items(e["entities"], "entity"), lambda n: n.withField("links", _items(n["links"], "link")))
        return _let(
            frames,
            lambda f: F.struct(
                e["entry_id"].alias("entry_id"), (i + 1).alias("place"),
                F.when(f.isNull(), asm).otherwise(F.concat(asm, _framed(f, "assembly", "assembly", "_entity_assembly", "component", "components"))).alias("asm"),
                F.when(f.isNull(), ent).otherwise(F.concat(ent, _framed(f, "entity", "entity", "_entity_db_link", "link", "links"))).alias("ent"),
            ),
        )

    def components_of(e: Column) -> Column:
        def of(a: Column, i: Column) -> Column:
            place = lambda j: (j + 1).cast("string")
            return F.transform(
                a["components"],
                lambda c, j: F.struct(
                    e["entry_id"].alias("entry_id"), e["place"].alias("entry_place"), (i + 1).alias("assembly_place"), a["id"].alias("assembly_id"), (j + 1).alias("component_place"),
                    F.when(c["id"] != "", c["id"]).otherwise(place(j)).alias("component_id"), c["entity_ref"].alias("entity_ref"), c["label"].alias("label"), c["state"].alias("state"), c["entity"].alias("entity"),
                ),
            )

        return F.flatten(F.transform(e["asm"], of))

    # an entity written inside a component belongs to the entry all the same
    def inside(c: Column) -> Column:
        return F.transform(_items(c["entity"], "entity"), lambda n: F.struct(c["entry_id"].alias("entry_id"), c["entry_place"].alias("entry_place"), n.withField("links", _items(n["links"], "link")).alias("n")))

    listed = F.flatten(F.transform("_e", lambda e: F.transform(e["ent"], lambda n: F.struct(e["entry_id"].alias("entry_id"), e["place"].alias("entry_place"), n.alias("n")))))
    ent = F.concat(listed, F.flatten(F.transform(F.filter("_cmp", lambda c: c["entity"].isNotNull()), inside)))

    assemblies = F.flatten(F.transform("_e", lambda e: F.transform(e["asm"], lambda a, i: F.struct(e["entry_id"].alias("entry_id"), e["place"].alias("entry_place"), (i + 1).alias("assembly_place"), a["id"].alias("assembly_id"), a["name"].alias("name"), a["details"].alias("details")))))
    entities = F.transform(
        "_ent",
        lambda x, i: F.struct(x["entry_id"].alias("entry_id"), x["entry_place"].alias("entry_place"), (i + 1).alias("entity_place"), x["n"]["id"].alias("entity_id"), *[x["n"][c].alias(c) for c in ("name", "details", "type", "polymer_type", "seq")]),
    )
    link = lambda x, i, k, j: F.struct(x["entry_id"].alias("entry_id"), x["entry_place"].alias("entry_place"), (i + 1).alias("entity_place"), x["n"]["id"].alias("entity_id"), (j + 1).alias("link_place"), k["code"].alias("database_code"), k["accession"].alias("accession_code"), k["mol_code"].alias("entry_mol_code"), k["identity"].alias("seq_identity"))
    links = F.flatten(F.transform("_ent", lambda x, i: F.transform(x["n"]["links"], lambda k, j: link(x, i, k, j))))
    return {
        "root": root, "top": top, "raw": raw, "e": F.transform("_raw", parts_of), "cmp": F.flatten(F.transform("_e", components_of)), "ent": ent,
        "assemblies": assemblies, "components": F.transform("_cmp", lambda c: c.dropFields("entity")), "entities": entities, "links": links,
    }


def flat_tables(df: DataFrame, keep: tuple[str, ...] = ("record_id",)) -> dict[str, DataFrame]:
    """The four target tables, one ``inline`` each.

    Rows keep ``record_id``, the entry id inside the payload, the ids of their
    ancestors and their places (1-based), so that parent and child join on
    (record_id, entry_place, assembly_place) and (record_id, entry_place,
    entity_place). Repeated nodes stay, told apart by their places.
    """
    base = normalized(df, keep)
    return {name: base.select(*keep, F.inline(name)) for name in ("assemblies", "components", "entities", "links")}


def node_rows(df: DataFrame) -> DataFrame:
    """One distinct row for each node of each record: record_id, entry_id, node_kind, parent_id, node_id, ref_id.

    Distinct within the record by ``array_distinct``, so nothing is shuffled; a
    record delivered in two rows gives its nodes twice unless the rows are
    dropped first. What does not apply is ``''``.
    """
    base = normalized(df)
    node = lambda e, kind, parent, own, ref: F.struct(e["entry_id"].alias("entry_id"), F.lit(kind).alias("node_kind"), parent.alias("parent_id"), own.alias("node_id"), ref.alias("ref_id"))
    blank = F.lit("")
    nodes = F.flatten(
        F.array(
            F.transform("assemblies", lambda a: node(a, "assembly", blank, a["assembly_id"], blank)),
            F.transform("components", lambda c: node(c, "component", c["assembly_id"], c["component_id"], c["entity_ref"])),
            F.transform("entities", lambda n: node(n, "entity", blank, n["entity_id"], blank)),
            F.transform("links", lambda x: node(x, "db_link", x["entity_id"], x["database_code"], x["accession_code"])),
        )
    )
    return base.select("record_id", F.inline(F.array_distinct(nodes))).select("record_id", *NODE_FIELDS)
