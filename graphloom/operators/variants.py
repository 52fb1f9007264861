"""Deeply nested documents to related flat tables.

A bottom-up tree automaton gives each value a state: leaves by kind; locations and metadata by the states of their members;
elements of the node and edge arrays by the states of theirs; the document itself likewise. The state of an element is its
structural variant. Elements are written once, each variant routed to the subtype table (a folder of its own) of those that
are read alike; typed readings of the subtypes that have a part make the flat tables, and other subtypes are not opened for
them. `elements` is the supertype table of what all variants have: document, owner kind, place in the array, variant and id,
which are also the links from every child row to its parent. What no property is known for stays in the table `rest`.

Payloads are read JVM-side as VARIANT values. Those that a VARIANT cannot hold (more than 128 MiB, a string of more than
20 million characters, a key given twice) are read element by element in Python; both readings give the same rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import CERTAINTIES, lookup
from ..session import small, written

#: What may stand around a payload: a byte order mark and blanks.
AROUND = "﻿ \t\r\n"
#: Properties of an element that have a column, with that column's name; edges have their ends besides.
TEXTS = {"id": "id", "type": "type", "displayname": "display_name", "repositoryname": "repository_name", "projectname": "project_name", "certainty": "certainty", "sourceid": "source_id", "targetid": "target_id"}
ENDS, PLACE = ("sourceid", "targetid"), ("filepath", "line", "column")
NESTED = ("sourcelocation", "metadata")
#: A value's members, or a list's entries: key, kind of the value, and the value as text (JSON for objects and arrays).
CELLS = "array<struct<key:string,kind:string,text:string>>"
_FIRST = "timestamp_ntz '0001-01-01 00:00:00'"
_RAW = f"document_id long, delivery long, exported timestamp_ntz, loaded timestamp_ntz, chars long, wrapper string, owner_kind string, owner_pos int, is_object boolean, members {CELLS}, place {CELLS}, entries {CELLS}"


# -- reading as VARIANT ------------------------------------------------------------------------------------------------
def members(v: Column) -> Column:
    """A VARIANT object as its (key, value) entries; null for anything else."""
    return F.map_entries(v.try_cast("map<string,variant>"))


def prop(entries: Column, name: str) -> Column:
    """The value of a property, found without regard to the case of its name; of several the last one holds."""
    found = F.filter(entries, lambda e: F.lower(e["key"]) == name)
    return F.get(found, F.size(found) - 1)["value"]


def _kind(schema: Column) -> Column:
    """State of a value by its kind alone, from its schema: none, object, array, text, flag or number."""
    return (
        F.when(schema.isNull() | (schema == "VOID"), "none")
        .when(schema.startswith("OBJECT"), "object")
        .when(schema.startswith("ARRAY"), "array")
        .when(schema == "STRING", "text")
        .when(schema == "BOOLEAN", "flag")
        .otherwise("number")
    )


def _cells(named: Column, without: tuple[str, ...] = ()) -> Column:
    """Array of (key, value) as cells; the texts of nested members `without` are left out, as they are read on their own.

    Step by step, as a lambda evaluates what it names several times anew each time.
    """
    schemas = F.transform(named, lambda m: F.struct(m["key"].alias("key"), m["value"].alias("value"), F.schema_of_variant(m["value"]).alias("schema")))
    kinds = F.transform(schemas, lambda m: F.struct(m["key"].alias("key"), m["value"].alias("value"), _kind(m["schema"]).alias("kind")))

    def cell(m: Column) -> Column:
        text = F.when(m["kind"].isin("object", "array"), F.to_json(m["value"])).otherwise(m["value"].try_cast("string"))
        if without:
            text = F.when(~(m["kind"].isin("object", "array") & F.lower(m["key"]).isin(*without)), text)
        return F.struct(m["key"].alias("key"), m["kind"].alias("kind"), text.alias("text"))

    return F.transform(kinds, cell)


def _listed(entries: Column) -> Column:
    """A list's {key, value} objects as (key, value); what has no key keeps its whole value."""
    parts = F.transform(entries, lambda x: F.struct(members(x).alias("own"), x.alias("x")))
    named = F.transform(parts, lambda p: F.struct(prop(p["own"], "key").try_cast("string").alias("key"), prop(p["own"], "value").alias("value"), p["x"].alias("x")))
    return F.transform(named, lambda p: F.struct(p["key"].alias("key"), F.when(p["key"].isNotNull(), p["value"]).otherwise(p["x"]).alias("value")))


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once a row, however often what follows names them or filters by them."""
    made = F.array(F.struct(*(c.alias(n) for n, c in columns.items())))
    return df.select("*", F.inline(made))


def _read(deliveries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(raw elements of the payloads that a VARIANT holds, deliveries that are left)."""
    v, r = F.col("v"), F.col("r")
    tried = _once(_once(deliveries, v=F.try_parse_json("text")), r=members(v))
    inner = F.try_parse_json(F.btrim(v.try_cast("string"), F.lit(AROUND)))
    tried = _once(tried, root=F.when(r.isNotNull(), r).otherwise(members(inner)))
    whole, left = tried.where("root is not null"), tried.where("root is null").drop("v", "r", "root")
    at = ["document_id", "delivery", "exported", "loaded", "chars"]
    root = _once(whole, nodes=prop(F.col("root"), "nodes").try_cast("array<variant>"), edges=prop(F.col("root"), "edges").try_cast("array<variant>"))
    # One row for the document itself, then one per element.
    head = [*at, F.when(r.isNotNull(), "object").otherwise("text>object").alias("wrapper")]
    items = lambda name: F.transform(F.coalesce(f"{name}s", F.array().cast("array<variant>")), lambda x, i: F.struct(F.lit(name).alias("owner_kind"), i.alias("owner_pos"), x.alias("x"), F.lit(None).cast("map<string,variant>").alias("top")))
    own = F.array(F.struct(F.lit("document").alias("owner_kind"), F.lit(-1).alias("owner_pos"), F.lit(None).cast("variant").alias("x"), F.map_from_entries("root").alias("top")))
    rows = root.select(*head, F.inline(F.concat(own, items("node"), items("edge"))))
    e, document = F.col("e"), F.col("owner_kind") == "document"
    rows = _once(rows, e=F.when(document, F.map_entries("top")).otherwise(members(F.col("x"))))
    rows = _once(rows.select(*at, "wrapper", "owner_kind", "owner_pos", "e"), place=F.when(~document, members(prop(e, "sourcelocation"))), meta=F.when(~document, prop(e, "metadata")))
    meta = F.col("meta")
    cells = F.when(document, _cells(e, ("nodes", "edges"))).otherwise(_cells(e, NESTED))
    entries = F.coalesce(_cells(members(meta)), _cells(_listed(meta.try_cast("array<variant>"))))
    return rows.select(*at, "wrapper", "owner_kind", "owner_pos", e.isNotNull().alias("is_object"), cells.alias("members"), _cells(F.col("place")).alias("place"), entries.alias("entries")), left


# -- reading in Python -------------------------------------------------------------------------------------------------
def _refuse(name: str):
    raise ValueError(name)


def _decoder() -> json.JSONDecoder:
    return json.JSONDecoder(parse_constant=_refuse)


_BLANK = json.decoder.WHITESPACE


def _whole(text: str) -> tuple[str, str, dict[str, int], list[tuple]] | None:
    """(wrapper, text, where the node and edge arrays start, the other members as cells) of a JSON object; None for any
    other text. Walks the text member by member and holds one element at a time."""
    text, wrapper = text.strip(AROUND), "object"
    try:
        if text.startswith('"'):
            text, end = _whole_string(text)
            if end is None:
                return None
            text, wrapper = text.strip(AROUND), "text>object"
        if not text.startswith("{"):
            return None
        read = _decoder().raw_decode
        lists: dict[str, int] = {}
        others: dict[str, tuple] = {}
        at = _BLANK.match(text, 1).end()
        while text[at] != "}":
            key, at = json.decoder.scanstring(text, at + 1) if text[at] == '"' else _refuse("key")
            at = _BLANK.match(text, at).end()
            at = _BLANK.match(text, at + 1).end() if text[at] == ":" else _refuse("colon")
            name = key.lower()
            if name in ("nodes", "edges"):
                lists.pop(name, None)  # of several the last one holds
                start = at
                if text[at] == "[":
                    lists[name] = start
                    for _, at in _items(text, start):
                        pass
                    others[key] = (key, "array", None)
                else:
                    value, at = read(text, at)
                    others[key] = _cell(key, value)
            else:
                value, at = read(text, at)
                others[key] = _cell(key, value)
            at = _BLANK.match(text, at).end()
            if text[at] == ",":
                at = _BLANK.match(text, at + 1).end()
                if text[at] == "}":
                    return None
            elif text[at] != "}":
                return None
        return (wrapper, text, lists, list(others.values())) if at == len(text) - 1 else None
    except (ValueError, IndexError, RecursionError):
        return None


def _whole_string(text: str) -> tuple[str, int | None]:
    inner, end = json.decoder.scanstring(text, 1)
    return inner, end if end == len(text) else None


def _items(text: str, at: int) -> Iterator[tuple[list, int]]:
    """The items of the array that starts at `at`, each as a list of one with the place behind it; the last place is behind
    the array. An empty array gives one empty list."""
    read = _decoder().raw_decode
    at = _BLANK.match(text, at + 1).end()
    if text[at] == "]":
        yield [], at + 1
        return
    while True:
        value, at = read(text, at)
        at = _BLANK.match(text, at).end()
        if text[at] == "]":
            yield [value], at + 1
            return
        if text[at] != ",":
            _refuse("comma")
        yield [value], at
        at = _BLANK.match(text, at + 1).end()


def _clean(text: str) -> str:
    """Lone surrogates, which no text column can hold, become question marks."""
    return text if text.isascii() else text.encode("utf-8", "replace").decode("utf-8")


def _cell(key: str, value, with_text: bool = True) -> tuple[str, str, str | None]:
    if value is None:
        return _clean(key), "none", None
    if isinstance(value, str):
        return _clean(key), "text", _clean(value)
    if isinstance(value, bool):
        return _clean(key), "flag", "true" if value else "false"
    if isinstance(value, (dict, list)):
        return _clean(key), "object" if isinstance(value, dict) else "array", _clean(json.dumps(value, ensure_ascii=False, separators=(",", ":"))) if with_text else None
    return _clean(key), "number", str(value)


def _named(value: dict, name: str):
    found = [v for k, v in value.items() if k.lower() == name]
    return found[-1] if found else None


def _element(value) -> tuple:
    """(is_object, members, place, entries) of one element."""
    if not isinstance(value, dict):
        return False, None, None, None
    place, meta = _named(value, "sourcelocation"), _named(value, "metadata")
    entries = None
    if isinstance(meta, dict):
        entries = [_cell(k, v) for k, v in meta.items()]
    elif isinstance(meta, list):
        entries = []
        for x in meta:
            name = _named(x, "key") if isinstance(x, dict) else None
            name = name if name is None or isinstance(name, str) else _cell("", name)[2]
            entries.append((None, *_cell("", x)[1:]) if name is None else _cell(name, _named(x, "value")))
    return True, [_cell(k, v, k.lower() not in NESTED) for k, v in value.items()], [_cell(k, v) for k, v in place.items()] if isinstance(place, dict) else None, entries


def _read_slowly(deliveries: DataFrame) -> DataFrame:
    """Raw elements of the payloads among `deliveries` that are whole JSON objects, element by element."""
    cells = pa.list_(pa.struct([("key", pa.string()), ("kind", pa.string()), ("text", pa.string())]))
    schema = pa.schema([("document_id", pa.int64()), ("delivery", pa.int64()), ("exported", pa.timestamp("us")), ("loaded", pa.timestamp("us")), ("chars", pa.int64()), ("wrapper", pa.string()), ("owner_kind", pa.string()), ("owner_pos", pa.int32()), ("is_object", pa.bool_()), ("members", cells), ("place", cells), ("entries", cells)])
    whole, items, element = _whole, _items, _element

    def rows_of(head: tuple, text: str) -> Iterator[tuple]:
        found = whole(text)
        if found is None:
            return
        wrapper, text, lists, others = found
        yield *head, wrapper, "document", -1, True, others, None, None
        for kind in ("node", "edge"):
            if kind + "s" in lists:
                for n, (found, _) in enumerate(items(text, lists[kind + "s"])):
                    for value in found:
                        yield *head, wrapper, kind, n, *element(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([tuple_to_cells(v) if f.type == cells else v for v in col], f.type) for col, f in zip(zip(*rows), schema)], schema=schema)
        tuple_to_cells = lambda v: None if v is None else [dict(zip(("key", "kind", "text"), c)) for c in v]
        for b in batches:
            for i in range(b.num_rows):
                head = tuple(b.column(n)[i].as_py() for n in ("document_id", "delivery", "exported", "loaded", "chars"))
                rows = []
                for row in rows_of(head, b.column("text")[i].as_py()):
                    rows.append(row)
                    if len(rows) == 1000:
                        yield to_batch(rows)
                        rows = []
                if rows:
                    yield to_batch(rows)

    return deliveries.mapInArrow(run, _RAW)


# -- states ------------------------------------------------------------------------------------------------------------
def _rest(cells: Column, known: tuple[str, ...]) -> Column:
    """Cells of properties that are not known and hold something."""
    return F.filter(cells, lambda c: ~F.lower(c["key"]).isin(*known) & (c["kind"] != "none"))


def _state(parts: dict[str, Column], rest: Column) -> Column:
    """State of an object from those of its known members, in the order of their names; unknown ones count together."""
    named = [F.when(s != "none", F.concat(F.lit(f"{n}:"), s)) for n, s in sorted(parts.items())]
    return F.concat_ws(",", *named, F.when(F.size(rest) > 0, F.lit("+rest")))


def classified(raw: DataFrame) -> DataFrame:
    """Raw elements with their columns, and the states `place_state`, `meta_state` and `shape`, computed bottom-up.

    The number of shapes is bounded by the kinds of the known properties, whatever documents hold besides.
    """
    # Cells backwards, with their names in lower case: of several with one name the last one holds.
    backward = lambda cells: F.reverse(cells)
    names = lambda cells: F.transform(F.reverse(cells), lambda c: F.lower(c["key"]))
    raw = _once(raw, own_cells=backward("members"), own_names=names("members"), place_cells=backward("place"), place_names=names("place"))
    cell = lambda of, n: F.get(f"{of}_cells", F.array_position(f"{of}_names", F.lit(n)).cast("int") - 1)
    kind = lambda of, n: F.coalesce(cell(of, n)["kind"], F.lit("none"))
    m, place = F.col("members"), F.col("place")
    # A part that should be an object but is none stays in `rest`, and has the state of its kind.
    own_place, own_meta = kind("own", "sourcelocation"), kind("own", "metadata")
    place_rest = F.coalesce(_rest(place, PLACE), F.array().cast(CELLS))
    place_state = F.when(own_place == "object", F.concat(F.lit("place("), _state({n: kind("place", n) for n in PLACE}, place_rest), F.lit(")"))).otherwise(own_place)
    # A map's entries have no order of their own, so they come in that of their keys.
    entries = F.when(own_meta == "object", F.array_sort("entries")).otherwise(F.col("entries"))
    values = F.array_join(F.array_sort(F.array_distinct(F.transform(entries, lambda c: F.when(c["key"].isNull(), F.concat(F.lit("keyless:"), c["kind"])).otherwise(c["kind"])))), "|")
    meta_state = F.when(own_meta == "object", F.concat(F.lit("map("), values, F.lit(")"))).when(own_meta == "array", F.concat(F.lit("list("), values, F.lit(")"))).otherwise(own_meta)
    document, edge = F.col("owner_kind") == "document", F.col("owner_kind") == "edge"
    texts = {n: cell("own", n) for n in TEXTS}
    known = (*(n for n in TEXTS if n not in ENDS), *NESTED)
    odd = F.filter(m, lambda c: F.lower(c["key"]).isin(*NESTED) & c["kind"].isin("text", "flag", "number") | ((F.lower(c["key"]) == "sourcelocation") & (c["kind"] == "array")))
    rest = F.when(document, _rest(m, ("nodes", "edges"))).when(edge, F.concat(_rest(m, (*known, *ENDS)), odd)).otherwise(F.concat(_rest(m, known), odd))
    staged = raw.select(
        "document_id", "delivery", "exported", "loaded", "chars", "wrapper", "owner_kind", "owner_pos", "is_object", entries.alias("entries"),
        *(F.when(~document & (F.lit(n not in ENDS) | edge), texts[n]).alias(f"t_{n}") for n in TEXTS),
        F.struct(*(cell("place", n)["text"].alias(n) for n in PLACE)).alias("place"),
        F.coalesce(rest, F.array().cast(CELLS)).alias("rest"), place_rest.alias("place_rest"),
        place_state.alias("place_state"), meta_state.alias("meta_state"),
        *(kind("own", n).alias(f"k_{n}") for n in ("nodes", "edges")),
    )
    text_states = {n: F.coalesce(F.col(f"t_{n}.kind"), F.lit("none")) for n in TEXTS}
    whole = F.when(document, _state({"nodes": F.col("k_nodes"), "edges": F.col("k_edges")}, F.col("rest"))).otherwise(_state({**text_states, "sourcelocation": F.col("place_state"), "metadata": F.col("meta_state")}, F.col("rest")))
    head = F.when(document, F.concat(F.lit("document:"), "wrapper")).otherwise(F.col("owner_kind"))
    shape = F.when(F.col("is_object"), F.concat(head, F.lit("("), whole, F.lit(")"))).otherwise(F.concat(head, F.lit(":no object")))
    none = F.lit("none")
    shaped = staged.select(
        "document_id", "delivery", "exported", "loaded", "chars", "owner_kind", "owner_pos", *(F.col(f"t_{n}.text").alias(c) for n, c in TEXTS.items()),
        "place", "entries", "rest", "place_rest", F.coalesce("place_state", none).alias("place_state"), F.coalesce("meta_state", none).alias("meta_state"), F.coalesce(F.col("t_certainty.kind"), none).alias("certainty_state"), shape.alias("shape"),
    )
    # What decides how a variant is read: the kind of its enum, and which parts it has.
    part = lambda has, name: F.when(has, name)
    subtype = F.concat_ws("-", F.concat(F.lit("enum_"), "certainty_state"), part(F.startswith("place_state", F.lit("place(")), "place"), part(F.startswith("meta_state", F.lit("map(")), "map"), part(F.startswith("meta_state", F.lit("list(")), "list"), part(F.contains("meta_state", F.lit("keyless:")), "keyless"), part(F.size("rest") > 0, "rest"), part(F.size("place_rest") > 0, "place_rest"))
    return shaped.withColumn("variant", F.lower(F.hex(F.xxhash64("shape")))).withColumn("subtype", subtype)


class Variants:
    """The elements of a table of documents, written once by structural variant, and the typed readings of them.

    `documents` is (document_id, exported_at, loaded_at, payload). A payload counts if it is a JSON object, or a JSON string
    that holds one. A document delivered again counts once: the latest export, then the latest load, then the longest
    payload. Rows without document_id are left out; documents without a whole payload are in `rejected`. A null, absent or
    non-array list has no elements; an element that is no object has a row in `elements` and no parts. Empty tables give
    empty results.
    """

    def __init__(self, documents: DataFrame) -> None:
        at = lambda n: F.coalesce(F.col(n).cast("timestamp_ntz"), F.expr(_FIRST))
        text = F.btrim(F.col("payload"), F.lit(AROUND))
        self._all = documents.where("document_id is not null").select(F.col("document_id").cast("long").alias("document_id"), F.monotonically_increasing_id().alias("delivery"), at("exported_at").alias("exported"), at("loaded_at").alias("loaded"), F.length("payload").cast("long").alias("chars"), text.alias("text"))
        read, left = _read(self._all.where("text != ''"))
        raw = read.unionByName(_read_slowly(left.select("document_id", "delivery", "exported", "loaded", "chars", "text")))
        # Rows of a subtype come together before they are written; large ones are split over tasks, small ones are not.
        routed = classified(raw).hint("rebalance", F.col("owner_kind"), F.col("subtype"))
        self._rows = written(routed, by=("owner_kind", "subtype"))
        of = self._rows.where("owner_kind = 'document'").select("document_id", "delivery", F.struct("exported", "loaded", "chars", "delivery").alias("age"))
        best = of.groupBy("document_id").agg(F.max("age.delivery").alias("last"), F.max_by("delivery", "age").alias("kept"), F.count("*").alias("n"))
        older = of.join(best.where("n > 1").select("document_id", "kept"), "document_id").where("delivery != kept").select("delivery")
        self._older = written(older)
        self._shapes = written(self._kept(self._rows).groupBy("owner_kind", "subtype", "variant", "shape").agg(F.count("*").alias("elements")))
        #: A row per kind and subtype, of which there are a few dozen at most.
        self._subtypes = {(r.owner_kind, tuple(r.subtype.split("-"))) for r in self._rows.select("owner_kind", "subtype").distinct().collect()}

    def _kept(self, rows: DataFrame) -> DataFrame:
        return rows.join(small(self._older), "delivery", "left_anti")

    def route(self, *parts: str, kinds: tuple[str, ...] = ("node", "edge")) -> DataFrame:
        """The rows of the subtypes that have any of `parts` (all where none is named); other subtypes' folders are not read."""
        chosen = sorted("-".join(has) for kind, has in self._subtypes if kind in kinds and (not parts or set(parts) & set(has)))
        return self._kept(self._rows.where(F.col("owner_kind").isin(*kinds) & F.col("subtype").isin(chosen)))

    @property
    def shapes(self) -> DataFrame:
        """(owner_kind, shape, elements): how many elements each structural variant has; documents themselves too."""
        return self._shapes.groupBy("owner_kind", "shape").agg(F.sum("elements").alias("elements"))

    @property
    def elements(self) -> DataFrame:
        """(document_id, owner_kind, owner_pos, variant, id): what all variants have."""
        return self.route().select("document_id", "owner_kind", "owner_pos", "variant", "id")

    def _typed(self, kind: str, ends: list[str]) -> DataFrame:
        columns = ["document_id", "owner_kind", "owner_pos", "id", "type", "display_name", "repository_name", "project_name", "certainty", *ends]
        by_name = lookup(F.col("certainty"), {n: i for i, n in enumerate(CERTAINTIES)})
        readings = {"enum_number": F.col("certainty").try_cast("tinyint"), "enum_text": by_name}
        out = self.route(*("enum_none", "enum_flag", "enum_object", "enum_array"), kinds=(kind,)).select(*columns, F.lit(None).cast("tinyint").alias("certainty_rank"))
        for enum, rank in readings.items():
            out = out.unionByName(self.route(enum, kinds=(kind,)).select(*columns, rank.cast("tinyint").alias("certainty_rank")))
        return out

    @property
    def nodes(self) -> DataFrame:
        """Node elements: values as written, and certainty_rank 0 to 3, by number or by name as the variant has it."""
        return self._typed("node", [])

    @property
    def edges(self) -> DataFrame:
        return self._typed("edge", ["source_id", "target_id"])

    @property
    def locations(self) -> DataFrame:
        """(document_id, owner_kind, owner_pos, file_path, line, column); numbers that do not fit are null."""
        rows = self.route("place")
        return rows.select("document_id", "owner_kind", "owner_pos", F.col("place.filepath").alias("file_path"), F.col("place.line").try_cast("int").alias("line"), F.col("place.column").try_cast("int").alias("column"))

    def _entries(self) -> DataFrame:
        rows = self.route("map", "list")
        keys = F.transform("entries", lambda c: c["key"])
        return rows.select("document_id", "owner_kind", "owner_pos", keys.alias("keys"), F.posexplode("entries").alias("entry_pos", "m")).where("m.key is not null").withColumn("is_first", F.array_position("keys", F.col("m.key")) == F.col("entry_pos") + 1)

    @property
    def metadata(self) -> DataFrame:
        """(document_id, owner_kind, owner_pos, entry_pos, key, value): entries in order, null values and repeated keys too."""
        return self._entries().select("document_id", "owner_kind", "owner_pos", "entry_pos", F.col("m.key").alias("key"), F.col("m.text").alias("value"))

    @property
    def rest(self) -> DataFrame:
        """(document_id, owner_kind, owner_pos, key, kind, value): everything that no other table has a column for."""
        at = ["document_id", "owner_kind", "owner_pos"]
        own = self.route("rest", kinds=("document", "node", "edge")).select(*at, F.inline("rest"))
        place = self.route("place_rest").select(*at, F.inline("place_rest")).withColumn("key", F.concat(F.lit("sourceLocation."), "key"))
        keyless = self.route("keyless").select(*at, F.posexplode("entries").alias("n", "m")).where("m.key is null").select(*at, F.concat(F.lit("metadata["), F.col("n").cast("string"), F.lit("]")).alias("key"), "m.kind", "m.text")
        return own.unionByName(place).unionByName(keyless).withColumnRenamed("text", "value")

    @property
    def rejected(self) -> DataFrame:
        """(document_id, reason): documents of which no delivery is a whole JSON object: `empty` or `damaged`."""
        read = self._rows.where("owner_kind = 'document'").select("document_id").distinct()
        one = self._all.groupBy("document_id").agg(F.count_if(F.coalesce(F.col("text") != "", F.lit(False))).alias("n"))
        return one.join(read, "document_id", "left_anti").select("document_id", F.when(F.col("n") == 0, "empty").otherwise("damaged").alias("reason"))

    @property
    def child_rows(self) -> DataFrame:
        """(document_id, owner_kind, owner_pos, child_kind, child_key): the records, locations and metadata entries of each
        element, each once, from the tables above."""
        at = ["document_id", "owner_kind", "owner_pos"]
        records = self.elements.select(*at, F.lit("record").alias("child_kind"), F.col("id").alias("child_key"))
        places = self.locations.select(*at, F.lit("location").alias("child_kind"), F.col("file_path").alias("child_key"))
        keys = self._entries().where("is_first").select(*at, F.lit("metadata").alias("child_kind"), F.col("m.key").alias("child_key"))
        return records.unionByName(places).unionByName(keys)
