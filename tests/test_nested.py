import json

from coilworks.operators import nested


def rows(spark, payloads, fn=nested.node_rows):
    df = spark.createDataFrame([(i, p, "x", "clash") for i, p in enumerate(payloads)], "record_id bigint, payload string, entry_id string, _root string")
    return fn(df)


def found(spark, payloads):
    """Nodes by payload, all in one query."""
    out = [set() for _ in payloads]
    for r in rows(spark, payloads).collect():
        out[r.record_id].add(tuple(r)[1:])
    return out


ENTRY = {"entry_id": "7", "assemblies": [{"ID": "1", "entities": [{"ID": "1", "Entity_ID": "2"}]}], "entities": [{"ID": 2, "db_links": [{"Database_code": "PDB", "Accession_code": "A1"}]}]}
NODES = {("7", "assembly", "", "1", ""), ("7", "component", "1", "1", "2"), ("7", "entity", "", "2", ""), ("7", "db_link", "2", "PDB", "A1")}


def test_container_shapes_give_the_same_nodes(spark):
    keyed = {"entry_id": 7, "Assemblies": {"1": {"Name": "s", "entity_assembly": {"ID": 1, "Entity_ID": 2}}}, "entity_list": {"2": {"name": "e", "DB_links": {"database_code": "PDB", "accession_code": "A1"}}}}
    table = {"Entry_ID": "7", "assembly_list": {"ID": "1", "entities": {"tags": ["Entity_ID", "ID"], "data": [["2", "1"]]}}, "entities": json.dumps(ENTRY["entities"])}
    inside = {"entry_id": "7", "assemblies": [{"id": "1", "entities": [{"id": "1", "entity_id": "2", "entity": {"id": "2", "db_links": [{"Database_code": "PDB", "Accession_code": "A1"}]}}]}], "entities": []}
    frames = {"entry_id": "7", "saveframes": [
        {"category": "assembly", "tags": [["ID", "1"]], "loops": [{"category": "_Note", "tags": ["Text"], "data": [["x"]]}, {"category": "_Entity_assembly", "tags": ["ID", "Entity_ID"], "data": [["1", "2"]]}]},
        {"category": "entity", "tags": [["ID", "2"]], "loops": [{"category": "_Entity_db_link", "tags": ["Accession_code", "Database_code"], "data": [["A1", "PDB"]]}]},
    ]}
    shapes = [ENTRY, keyed, table, inside, frames, {"data": {"entry": ENTRY}}, {"entries": [ENTRY]}, [ENTRY], {"entry": frames}, json.dumps(ENTRY)]
    for shape, got in zip(shapes, found(spark, [json.dumps(s) for s in shapes])):
        assert got == NODES, shape


def test_unreadable_payloads_give_nothing(spark):
    assert found(spark, []) == []
    assert rows(spark, [None, "", "{", "<html>", '{"entry_id": "7"} tail', '{"entry_id": "1"}{"entry_id": "2"}', "[1", "12"]).count() == 0


def test_missing_ids_and_repeats(spark):
    p = {"entry_id": None, "assemblies": [{"ID": ".", "entities": [{"Entity_ID": "."}, {"Entity_ID": "3"}, {"ID": "1", "Entity_ID": None}]}], "entities": [{"ID": "4"}, {"ID": "4"}]}
    got, one, two = found(spark, [json.dumps(p), json.dumps(ENTRY), json.dumps(ENTRY)])
    assert got == {("", "assembly", "", "", ""), ("", "component", "", "1", ""), ("", "component", "", "2", "3"), ("", "entity", "", "4", "")}
    assert one == two == NODES


def test_flat_tables_keep_parents(spark):
    two = {"entries": [ENTRY, dict(ENTRY, entry_id="8")]}
    t = rows(spark, [json.dumps(two)], nested.flat_tables)
    joined = t["components"].join(t["assemblies"], ["record_id", "entry_place", "assembly_place"])
    assert joined.count() == 2
    assert sorted(r.entity_id for r in t["links"].collect()) == ["2", "2"]
    assert t["links"].join(t["entities"], ["record_id", "entry_place", "entity_place"]).count() == 2


def test_keys_written_twice(spark):
    whole = json.dumps(ENTRY)
    inner = json.dumps(ENTRY["entities"]).replace('"ID": 2', '"ID": 1, "ID": 2')
    before = spark.conf.get("spark.sql.variant.allowDuplicateKeys")
    got = found(spark, [whole.replace('"entry_id": "7"', '"entry_id": "6", "entry_id": "7"'), json.dumps(ENTRY | {"entities": inner})])
    assert got == [NODES, NODES] and spark.conf.get("spark.sql.variant.allowDuplicateKeys") == before
