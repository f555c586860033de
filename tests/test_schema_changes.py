"""What the change of a schema means: keyword by keyword, and as a whole."""

import itertools
import json

from palisade.operators import schemas

CASES = [
    # keyword, from what allows least to what allows most
    ("maxLength", [1, 5, None]), ("maximum", [-3, 0.5, None]), ("minimum", [7, 1, None]), ("minItems", [3, 1, None]),
    ("enum", [["a"], ["a", "b"], None]), ("type", ["string", ["string", "null"], None]), ("required", [["a", "b"], ["a"], None]),
    ("additionalProperties", [False, {"type": "string"}, None]), ("uniqueItems", [True, None]), ("pattern", ["^a$", None]), ("const", [1, None]), ("format", ["uri", None]),
]
KIND = "id long, input_schema string"


def wrap(name, node):
    return json.dumps({"type": "object", "properties": {} if node is None else {name: node}})


def test_keywords_have_an_order(spark):
    old, new, want, n = [], [], {}, 0
    for keyword, values in CASES:
        for a, b in itertools.permutations(values, 2):
            nodes = [{"x": 1} | ({} if v is None else {keyword: v}) for v in (a, b)]
            old.append((n, wrap("p", nodes[0])))
            new.append((n, wrap("p", nodes[1])))
            more = values.index(b) > values.index(a)
            want[n] = ([keyword] if more else [], [] if more else [keyword])
            n += 1
    got = {r["id"]: (r["loosened"], r["tightened"]) for r in schemas.schema_changes(spark.createDataFrame(old, KIND), spark.createDataFrame(new, KIND), ["id"]).collect()}
    assert got == want
    both = schemas.schema_changes(spark.createDataFrame([(1, wrap("p", {"pattern": "a"}))], KIND), spark.createDataFrame([(1, wrap("p", {"pattern": "b"}))], KIND), ["id"]).first()
    assert (both["loosened"], both["tightened"], both["severity"]) == (["pattern"], ["pattern"], "behavioral")


def test_removal_outranks_addition(spark):
    bound = {"type": "string", "maxLength": 9}
    pairs = [("path", bound, {"type": "string"}), ("path", {"type": "string"}, bound), ("n", bound, {"type": "string"}), ("n", {"type": "string"}, bound), ("Secret", None, {}), ("n", {"title": "a"}, {"title": "b"})]
    old = spark.createDataFrame([(i, wrap(n, a)) for i, (n, a, _) in enumerate(pairs)], KIND)
    new = spark.createDataFrame([(i, wrap(n, b)) for i, (n, _, b) in enumerate(pairs)], KIND)
    got = {r["id"]: (r["severity"], r["weight"]) for r in schemas.schema_changes(old, new, ["id"]).collect()}
    assert got == {0: ("security", 5), 1: ("security", 4), 2: ("behavioral", 3), 3: ("behavioral", 2), 4: ("security", 4), 5: ("cosmetic", 0)}


def test_severity_of_whole_schemas(spark):
    deep = {"type": "string"}
    for _ in range(200):
        deep = {"type": "object", "properties": {"d": deep}}
    pairs = [
        (wrap("path", {"type": "string"}), wrap("path", {"type": "number"}), "security"),
        (wrap("n", {"type": "string"}), wrap("n", {"type": "number"}), "behavioral"),
        (wrap("n", {"title": "a"}), wrap("n", {"title": "b"}), "cosmetic"),
        (wrap("n", {}), json.dumps({"type": "object", "properties": {"n": {}}, "required": ["n"]}), "behavioral"),
        (wrap("n", {}), "[1]", "behavioral"),
        (wrap("n", {}), "{broken", "behavioral"),
        (wrap("n", {}), json.dumps(deep), "security"),
        (wrap("n", {}), wrap("n", {}), None),
        (None, wrap("n", {}), "behavioral"),
    ]
    old, new = (spark.createDataFrame([(i, p[k]) for i, p in enumerate(pairs)], KIND) for k in (0, 1))
    got = {r["id"]: r["severity"] for r in schemas.schema_severity(old, new, ["id"]).collect()}
    assert got == {i: p[2] for i, p in enumerate(pairs) if p[2]}
    assert schemas.schema_severity(old.limit(0), new, ["id"]).count() == 0
