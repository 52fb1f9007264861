import json
from datetime import datetime

from graphloom.operators import variants

SCHEMA = "document_id long, exported_at timestamp_ntz, loaded_at timestamp_ntz, payload string, root string, owner_kind string"
T = datetime(2025, 1, 1)


def docs(spark, *payloads):
    return spark.createDataFrame([(i, T, T, p, "x", "y") for i, p in payloads], SCHEMA)


CAMEL = {"nodes": [{"id": "N1", "type": 3, "displayName": "a", "sourceLocation": {"filePath": "src\\A.cs", "line": 3, "column": None}, "certainty": "Exact", "metadata": {"k": "v", "n": None}}, {"id": "N2", "metadata": None, "sourceLocation": None}], "edges": [{"id": "e", "sourceId": "N1", "targetId": "N2", "certainty": 2, "metadata": [{"key": "x", "value": "1"}, {"key": "x", "value": "2"}, {"key": "y", "value": None}]}]}
PASCAL = {"Edges": None, "Nodes": [{"Id": "P", "Metadata": {"Key": "Value"}, "SourceLocation": {"FilePath": "f"}}]}


def test_all_spellings_and_damage(spark):
    text = json.dumps(CAMEL)
    d = docs(spark, (1, text), (1, text), (2, "﻿" + json.dumps(PASCAL)), (3, json.dumps(text)), (4, text[:-20]), (5, None), (6, ""), (7, "[1, 2]"), (8, "{}"), (9, '"no json"'), (10, '{"nodes": 5, "edges": [null, 3]}'), (None, text), (11, json.dumps(PASCAL, indent=2)))
    got = {tuple(r) for r in variants.Variants(d).child_rows.collect()}
    camel = {("node", 0, "record", "N1"), ("node", 0, "location", "src\\A.cs"), ("node", 0, "metadata", "k"), ("node", 0, "metadata", "n"), ("node", 1, "record", "N2"), ("edge", 0, "record", "e"), ("edge", 0, "metadata", "x"), ("edge", 0, "metadata", "y")}
    pascal = {("node", 0, "record", "P"), ("node", 0, "location", "f"), ("node", 0, "metadata", "Key")}
    want = {(i, *r) for i in (1, 3) for r in camel} | {(i, *r) for i in (2, 11) for r in pascal} | {(10, "edge", 0, "record", None), (10, "edge", 1, "record", None)}
    assert got == want


def test_a_whole_delivery_wins_over_a_damaged_one(spark):
    text = json.dumps(PASCAL)
    assert variants.Variants(docs(spark, (1, text[:-3]), (1, text))).child_rows.count() == 3


def test_flat_tables_and_shapes(spark):
    t = variants.Variants(docs(spark, (1, json.dumps(CAMEL)), (2, json.dumps(json.dumps(PASCAL)))))
    assert {tuple(r) for r in t.locations.collect()} == {(1, "node", 0, "src\\A.cs", 3, None), (2, "node", 0, "f", None, None)}
    assert {tuple(r) for r in t.metadata.collect()} == {(1, "node", 0, 0, "k", "v"), (1, "node", 0, 1, "n", None), (1, "edge", 0, 0, "x", "1"), (1, "edge", 0, 1, "x", "2"), (1, "edge", 0, 2, "y", None), (2, "node", 0, 0, "Key", "Value")}
    assert [(r.id, r.source_id, r.target_id, r.certainty, r.certainty_rank) for r in t.edges.collect()] == [("e", "N1", "N2", "2", 2)]
    assert {(r.id, r.type, r.certainty_rank) for r in t.nodes.collect()} == {("N1", "3", 3), ("N2", None, None), ("P", None, None)}
    assert {(r.owner_kind, r.shape): r.elements for r in t.shapes.collect()} == {
        ("document", "document:object(edges:array,nodes:array)"): 1,
        ("document", "document:text>object(nodes:array)"): 1,
        ("node", "node(certainty:text,displayname:text,id:text,metadata:map(none|text),sourcelocation:place(filepath:text,line:number),type:number)"): 1,
        ("node", "node(id:text)"): 1,
        ("node", "node(id:text,metadata:map(text),sourcelocation:place(filepath:text))"): 1,
        ("edge", "edge(certainty:number,id:text,metadata:list(none|text),sourceid:text,targetid:text)"): 1,
    }
    assert len({r.variant for r in t.elements.collect()}) == 4


def test_what_has_no_column_stays_reachable(spark):
    d = {"version": 2, "nodes": [{"id": "a", "color": {"r": 1}, "sourceId": "x", "metadata": "odd", "sourceLocation": {"filePath": "f", "end": 9}}, "no object"], "edges": [{"id": "e", "metadata": [5, {"key": "k", "value": [1]}]}]}
    t = variants.Variants(docs(spark, (1, json.dumps(d))))
    assert {tuple(r) for r in t.rest.collect()} == {
        (1, "document", -1, "version", "number", "2"), (1, "node", 0, "color", "object", '{"r":1}'), (1, "node", 0, "sourceId", "text", "x"), (1, "node", 0, "metadata", "text", "odd"),
        (1, "node", 0, "sourceLocation.end", "number", "9"), (1, "edge", 0, "metadata[0]", "number", "5"),
    }
    assert {(r.key, r.value) for r in t.metadata.collect()} == {("k", "[1]")}
    assert {(r.owner_kind, r.owner_pos, r.id) for r in t.elements.collect()} == {("node", 0, "a"), ("node", 1, None), ("edge", 0, "e")}


def test_rejected_documents_are_reported(spark):
    t = variants.Variants(docs(spark, (1, None), (2, " "), (3, "{"), (4, "[]"), (5, None), (5, "{}"), (None, "{")))
    assert {tuple(r) for r in t.rejected.collect()} == {(1, "empty"), (2, "empty"), (3, "damaged"), (4, "damaged")}


def test_payloads_that_no_variant_holds(spark):
    """A key given twice, and a string beyond 20 million characters, alone and in a wrapped document."""
    long = "x" * 20_100_000
    twice = '{"nodes": [{"id": "a"}], "nodes": [{"id": "b", "id": "c", "metadata": {"k": 1, "k": true}}, null], "edges": []}'
    t = variants.Variants(docs(spark, (1, twice), (2, json.dumps({"nodes": [{"id": "n", "displayName": long}]})), (3, json.dumps(json.dumps({"edges": [{"id": "e", "pad": long}]}))), (4, twice[:-2]), (5, twice + "x")))
    assert {(r.document_id, r.owner_kind, r.owner_pos, r.id) for r in t.elements.collect()} == {(1, "node", 0, "c"), (1, "node", 1, None), (2, "node", 0, "n"), (3, "edge", 0, "e")}
    assert [(r.key, r.value) for r in t.metadata.collect()] == [("k", "true")]
    assert t.nodes.where("document_id = 2").selectExpr("length(display_name)").first()[0] == len(long)
    assert {r.document_id for r in t.rejected.collect()} == {4, 5}


def test_both_readings_are_alike(spark):
    payloads = [json.dumps(CAMEL), json.dumps(json.dumps(PASCAL)), '{"Nodes": [1, [], {"Id": 5, "type": 1.5, "certainty": false, "metadata": [{"Key": 7}, {}, "x"], "z": "\\u00e9\\ud83d\\ude00"}], "edges": {"a": 1}}', '{"nodes": [{"metadata": {"z": 1, "b": null, "ab": "x"}}]  ,"x":null }']
    d = docs(spark, *enumerate(payloads)).selectExpr("document_id", "document_id delivery", "exported_at exported", "loaded_at loaded", "cast(1 as long) chars", "payload text")
    rows = lambda df: sorted(map(str, variants.classified(df).collect()))
    assert rows(variants._read(d)[0]) == rows(variants._read_slowly(d))


def test_large_document_and_empty_table(spark):
    big = json.dumps({"nodes": [{"id": f"n{i}", "metadata": {"t": "x" * 200}} for i in range(5000)]})
    assert variants.Variants(docs(spark, (1, big))).child_rows.count() == 10_000
    t = variants.Variants(docs(spark))
    assert t.child_rows.count() == t.rest.count() == t.shapes.count() == t.rejected.count() == 0
