"""Routes, verbs and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Attribute names (`Attribute` at their end may be left out) and the verb each stands for.
ATTRIBUTE_VERBS = {"HttpGet": "GET", "HttpPost": "POST", "HttpPut": "PUT", "HttpDelete": "DELETE", "HttpPatch": "PATCH", "HttpHead": "HEAD", "HttpOptions": "OPTIONS"}
# Route mapping calls and their verb.
MAP_VERBS = {"MapGet": "GET", "MapPost": "POST", "MapPut": "PUT", "MapDelete": "DELETE", "MapPatch": "PATCH"}
# Client calls and their verb.
CLIENT_VERBS = {
    "GetAsync": "GET", "GetFromJsonAsync": "GET", "PostAsync": "POST", "PostAsJsonAsync": "POST", "PutAsync": "PUT", "PutAsJsonAsync": "PUT",
    "DeleteAsync": "DELETE", "PatchAsync": "PATCH", "SendAsync": "SEND",
}


def verb(name: Column, table: dict[str, str], exact_case: bool = False) -> Column:
    """The verb of an attribute or call name, or null."""
    plain = F.regexp_replace(name, "(?i)Attribute$", "")
    pairs = [F.lit(x) for k, v in table.items() for x in ((k if exact_case else k.lower()), v)]
    return F.try_element_at(F.create_map(*pairs), plain if exact_case else F.lower(plain))


def segments(path: Column) -> Column:
    """Parts between slashes, without empty ones."""
    return F.filter(F.split(path, "/"), lambda s: s != "")


def normalize_route(class_route: Column, method_route: Column, controller: Column, action: Column) -> Column:
    """The parts that are not blank, without slashes at their ends, joined; `[controller]` and `[action]` filled in."""
    trimmed = F.transform(F.array(class_route, method_route), lambda r: F.btrim(r, F.lit("/")))
    joined = F.array_join(F.filter(trimmed, lambda r: r.rlike(r"\S")), "/")
    name = F.regexp_replace(controller, "(?i)Controller", "")
    joined = F.regexp_replace(joined, F.lit(r"(?i)\[controller\]"), F.regexp_replace(F.coalesce(name, F.lit("")), r"([\\$])", r"\\$1"))
    joined = F.regexp_replace(joined, F.lit(r"(?i)\[action\]"), F.regexp_replace(F.coalesce(action, F.lit("")), r"([\\$])", r"\\$1"))
    return F.concat(F.lit("/"), F.btrim(joined, F.lit("/")))


def route_matches(path: Column, route: Column) -> Column:
    """Same number of segments, each equal without regard to case or a `{parameter}` of the route."""
    a, b = segments(path), segments(route)
    pairs = F.zip_with(a, b, lambda x, y: (F.startswith(y, F.lit("{")) & F.endswith(y, F.lit("}"))) | (F.upper(x) == F.upper(y)))
    return F.coalesce((F.size(a) == F.size(b)) & F.forall(pairs, lambda ok: ok), F.lit(False))


def absolute_url(text: Column) -> Column:
    """The text if it is an absolute address, else null."""
    return F.when(text.rlike(r"^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/\s?#]+"), F.btrim(text))


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def url_path(url: Column) -> Column:
    return F.when(url.isNotNull(), F.coalesce(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit("")), F.lit("/")))


def combine_uri(base: Column, request: Column) -> Column:
    """An absolute request stays; else it is resolved against an absolute base; else null.

    `/x` replaces the base's path, `x` its last segment, `?q` its query; `.` and `..` segments are not folded.
    """
    b, r = absolute_url(base), F.btrim(request)
    origin = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    folder = F.regexp_replace(url_path(b), "[^/]*$", "")
    joined = F.when(F.startswith(r, F.lit("/")), F.concat(origin, r)).when(F.startswith(r, F.lit("?")), F.concat(origin, url_path(b), r)).otherwise(F.concat(origin, folder, r))
    return F.coalesce(absolute_url(r), F.when(b.isNotNull() & r.rlike(r"\S"), joined))


def constant_text(parts: Column, mode: str) -> Column:
    """An interpolated text from array<struct<text, value>>: literal text, or the constant value of a hole (null if it has none).

    mode `strict`: null as soon as one hole has no constant; `placeholder`: such a hole reads `{value}`; `constant`: null if there is any hole.
    """
    hole = lambda p: p["text"].isNull()
    if mode == "placeholder":
        return F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], p["value"], F.lit("{value}"))), "")
    whole = F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], p["value"])), "")
    bad = F.exists(parts, lambda p: hole(p) & p["value"].isNull()) if mode == "strict" else F.exists(parts, hole)
    return F.when(~bad, whole)
