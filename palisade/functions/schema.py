"""Walks over JSON Schemas: a table function for their nodes and properties, and canonical forms.

Recursion over data of any depth is what Column expressions lack; each document is
walked on its own by a small helper inside a task.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import PandasUDFType

MAX_DEPTH, MAX_NODES = 32, 10_000
#: The keywords that hold schemas, in the order of the standard's vocabularies, whether they hold one
#: schema, a list or a map of them, and how the path of a property goes on below (None: the path of a property is not
#: followed there).
KEYWORDS = {
    "$defs": ("map", None),
    "definitions": ("map", None),
    "allOf": ("list", ""),
    "anyOf": ("list", "[{}]"),
    "oneOf": ("list", "[{}]"),
    "not": ("one", ""),
    "if": ("one", ""),
    "then": ("one", ""),
    "else": ("one", ""),
    "dependentSchemas": ("map", None),
    "prefixItems": ("list", "[{}]"),
    "items": ("one", ".items"),
    "contains": ("one", ""),
    "properties": ("map", ".{}"),
    "patternProperties": ("map", ".pattern[{}]"),
    "additionalProperties": ("one", ""),
    "propertyNames": ("one", ""),
    "unevaluatedProperties": ("one", ""),
}
#: Annotations, which only document a schema.
DROPPED = ("title", "description", "$comment", "examples")

PROPERTIES = "path string, name string, node string, top boolean, limited boolean"
NODES = "pointer string, node string, limited boolean"


class Place(NamedTuple):
    """A schema inside a document: where it stands (unescaped pointer), the path of the property around it, how it is reached."""

    node: dict
    pointer: tuple[str, ...] = ("#",)
    path: str = ""
    name: str | None = None  # of the property that this is
    top: bool = False
    depth: int = 0
    followed: frozenset[str] = frozenset()


def children(place: Place, follow: bool) -> Iterator[Place]:
    """The schemas right below; ``follow`` goes the ways of properties, and those of local references, each once on a way."""
    for keyword, (kind, goes_on) in KEYWORDS.items():
        held = place.node.get(keyword)
        if kind == "map":
            below = held.items() if isinstance(held, dict) else ()
        elif kind == "list":
            below = enumerate(held) if isinstance(held, list) else ()
        else:
            below = [(None, held)]
        if follow and goes_on is None:
            continue
        for key, node in below:
            if not isinstance(node, dict):
                continue
            step = (goes_on or "").format(key)
            if step[:1] == ".":  # names are joined by dots; items of the document itself have no name
                step = place.path + step if place.path else "" if keyword == "items" else step[1:]
            else:
                step = place.path + step
            yield place._replace(
                node=node,
                pointer=(*place.pointer, keyword, *(() if key is None else (str(key),))),
                path=step,
                name=str(key) if keyword == "properties" else None,
                top=not place.path,
                depth=place.depth + 1,
            )


def places(document: Any, follow: bool) -> Iterator[Place]:
    """Every schema of a document, parents first; a RecursionError at a limit of depth or number."""
    if not isinstance(document, dict):
        return
    waiting, seen = [Place(document)], 0
    while waiting:
        place = waiting.pop()
        seen += 1
        if place.depth > MAX_DEPTH or seen > MAX_NODES:
            raise RecursionError("schema limit")
        yield place
        below = list(children(place, follow))
        ref = place.node.get("$ref")
        if follow and isinstance(ref, str) and ref.startswith("#/") and ref not in place.followed:
            target: Any = document
            for part in ref[2:].split("/"):
                part = part.replace("~1", "/").replace("~0", "~")
                target = target.get(part) if isinstance(target, dict) else None
            if isinstance(target, dict):
                below.append(place._replace(node=target, name=None, depth=place.depth + 1, followed=place.followed | {ref}))
        waiting += reversed(below)


def properties(document: Any) -> Iterator[tuple[str, str, dict, bool]]:
    """(path, name, node, whether it is a top-level property) of every property."""
    return ((x.path, x.name, x.node, x.top) for x in places(document, True) if x.name is not None)


def pointer(place: Place) -> str:
    """The JSON pointer of a place, as a URI fragment."""
    return "/".join(part.replace("~", "~0").replace("/", "~1") for part in place.pointer)


def canonical(text: str | None) -> str | None:
    """JSON text with sorted keys; null if it is none."""
    try:
        return None if text is None else json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"))
    except ValueError:
        return None


def semantic(value: Any) -> Any:
    """The schema without what only documents it."""
    if isinstance(value, dict):
        return {k: semantic(v) for k, v in value.items() if k not in DROPPED}
    return [semantic(v) for v in value] if isinstance(value, list) else value


def _walked(tools: DataFrame, keys: list[str], column: str, schema: str, rows_of) -> DataFrame:
    """keys and what ``rows_of`` gives for each row's schema, and after a limit a last row that says so."""
    kinds = dict(tools.dtypes)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for *own, text in batch.itertuples(index=False, name=None):
                try:
                    value = json.loads(text) if text else None
                    for row in rows_of(value):
                        rows.append((*own, *row, False))
                except RecursionError:
                    rows.append((*own, *[None] * (len(names) - 1), True))
                except ValueError:
                    continue
            yield pd.DataFrame(rows, columns=[*keys, *names])

    return tools.select(*keys, column).mapInPandas(run, ", ".join([f"`{k}` {kinds[k]}" for k in keys] + [schema]))


def _text(node: dict) -> str:
    return json.dumps(node, sort_keys=True)


def schema_properties(tools: DataFrame, keys: list[str], column: str = "input_schema") -> DataFrame:
    """keys, path, name, node (JSON text), top, limited: the properties of each row's schema.

    A schema that exceeds a limit gives what was found and one last row that says so; text that is no JSON gives none.
    """
    rows_of = lambda value: ((path, name, _text(node), top) for path, name, node, top in properties(value))
    return _walked(tools, keys, column, PROPERTIES, rows_of)


def schema_nodes(tools: DataFrame, keys: list[str], column: str = "input_schema") -> DataFrame:
    """keys, pointer, node (JSON text), limited: every schema inside each row's schema by its JSON pointer; no reference is followed."""
    rows_of = lambda value: ((pointer(x), _text(x.node)) for x in places(value, False))
    return _walked(tools, keys, column, NODES, rows_of)


def canonical_json(column: str) -> Column:
    """JSON text in canonical form."""
    return F.pandas_udf(lambda text: text.map(canonical), "string", functionType=PandasUDFType.SCALAR)(column)


def semantic_json(column: str) -> Column:
    """JSON text of a schema without what only documents it, in canonical form; null if it is none."""

    def one(text: str | None) -> str | None:
        if canonical(text) is None:
            return None
        return json.dumps(semantic(json.loads(text)), sort_keys=True, separators=(",", ":"))

    return F.pandas_udf(lambda text: text.map(one), "string", functionType=PandasUDFType.SCALAR)(column)
