"""Rules over the properties of tool schemas, and the difference of two schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.schema import schema_properties, semantic_json
from ..functions.text import unicode_pattern

#: Shell syntax in a value, dangerous defaults, patterns that allow anything, values like commands.
METACHARACTERS = r"\$\(|`|\|\||&&|;\s*(?:nc|netcat|curl|wget)\b|>>|>\s*/dev/null|2>&1|>\s*\("
DANGEROUS_DEFAULT = (
    r"^\s*(?:rm\s+-[a-z]*r[a-z]*f|rm\s+-[a-z]*f[a-z]*r|drop\s+(?:table|database)\b|shutdown\b|reboot\b|halt\b|mkfs\b|dd\s+if="
    r"|/bin/(?:ba)?sh\b|cmd\.exe\b|powershell(?:\.exe)?\b|(?:curl|wget)\s+\S+\s*\|\s*(?:ba)?sh\b)"
)
BROAD_PATTERN = r"^\.\*|\.\+$|\\[wWdDsS]\*.*\\[wWdDsS]\*|\[\.\*\][\+\*]|\(\.\*\)"
COMMAND_VALUES = ("bash", "sh", "zsh", "cmd", "powershell", "python -c", "eval", "exec", "execute", "system", "shell", "/bin/bash", "/bin/sh", "cmd.exe")
#: Keywords that say what a property may be, beside a reference.
TYPED = ("type", "enum", "const", "allOf", "anyOf", "oneOf")
#: Names of properties that hold paths, and constraints of strings.
PATH_NAMES = ("path", "file", "filepath", "filename", "source", "dest", "destination", "directory", "dir", "target", "output")
CONSTRAINTS = ("enum", "const", "maxLength", "minLength", "pattern", "format")
#: Parts of the names of tools that write.
WRITING_NAMES = ("write", "create", "edit", "move", "remove", "delete")


def _field(name: str) -> Column:
    return F.get_json_object("node", f"$.{name}")


def _has(name: str) -> Column:
    return _field(name).isNotNull()


def _findings(props: DataFrame, keys: list[str], *cases: tuple[str, Column | str, Column]) -> DataFrame:
    """keys, schema, path, issue, severity: one row for each case (issue, severity, condition) that holds."""
    case = lambda a, b, c: F.when(c, F.struct(F.lit(a).alias("issue"), (F.lit(b) if isinstance(b, str) else b).alias("severity")))
    each = F.array_compact(F.array(*[case(*x) for x in cases]))
    return props.select(*keys, "schema", "path", F.explode(each).alias("f")).select(*keys, "schema", "path", "f.*")


def both_properties(tools: DataFrame, keys: list[str]) -> DataFrame:
    """``schema_properties`` of the input schema and, if the tools have one, of the output schema (column ``schema``)."""
    found = [
        schema_properties(tools, keys, f"{x}_schema").withColumn("schema", F.lit(x)) for x in ("input", "output") if f"{x}_schema" in tools.columns
    ]
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def command_injection(tools: DataFrame, keys: list[str]) -> DataFrame:
    """R107: shell syntax in a default or example; in inputs also dangerous defaults, patterns that allow anything, and each command value."""
    text = lambda name: F.coalesce(_field(name), F.lit(""))
    of_input = F.col("schema") == "input"
    props = both_properties(tools, keys)
    single = _findings(
        props,
        keys,
        ("shell syntax in default", "critical", text("default").rlike(METACHARACTERS)),
        ("shell syntax in example", "critical", text("example").rlike(METACHARACTERS)),
        ("dangerous default", "critical", of_input & text("default").rlike(unicode_pattern(DANGEROUS_DEFAULT))),
        ("broad pattern", "high", of_input & text("pattern").rlike(BROAD_PATTERN)),
        ("broad regex", "high", of_input & text("regex").rlike(BROAD_PATTERN)),
    )
    values = F.filter(F.from_json(_field("enum"), "array<string>"), lambda v: F.lower(F.trim(v)).isin(*COMMAND_VALUES))
    each = props.where(of_input).select(*keys, "schema", "path", F.explode(values).alias("value"))
    return single.unionByName(each.select(*keys, "schema", "path", F.lit("command value").alias("issue"), F.lit("high").alias("severity")))


def loose_schemas(tools: DataFrame, keys: list[str]) -> DataFrame:
    """R109: what a top-level object schema leaves open, and its properties without a type or with huge limits."""
    schemas = [x for x in ("input", "output") if f"{x}_schema" in tools.columns]
    rows = [tools.select(*keys, F.lit(x).alias("schema"), F.col(f"{x}_schema").alias("node")) for x in schemas]
    node = rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])
    some = F.coalesce(_field("properties"), F.lit("{}")) != "{}"
    whole = _findings(
        node.withColumn("path", F.lit("")),
        keys,
        ("additional properties allowed", "low", _field("additionalProperties") == "true"),
        ("nothing required", "low", some & (F.coalesce(_field("required"), F.lit("[]")) == "[]")),
    )
    # Only the schema's own properties count, not those that a reference or composition adds.
    named = F.from_json(_field("properties"), "map<string,string>")
    own = node.select(*keys, "schema", F.explode(named).alias("path", "node")).where("startswith(node, '{')")
    typed = F.greatest(*[_has(x) for x in TYPED], F.get_json_object("node", "$['$ref']").isNotNull())
    large = lambda name, most: F.coalesce(_field(name).try_cast("double") > most, F.lit(False))
    single = _findings(
        own,
        keys,
        ("no type", "medium", ~typed),
        ("huge maxLength", "medium", large("maxLength", 1e6)),
        ("huge maxItems", "medium", large("maxItems", 1e5)),
    )
    return whole.unionByName(single)


def unconstrained_paths(tools: DataFrame, keys: list[str]) -> DataFrame:
    """R113 for parameters: path-like strings without a pattern or a format (medium in tools whose name says that they write).

    In an output schema only the lack of a pattern counts. ``tools`` has a name.
    """
    named = tools.select(*keys, F.col("name").alias("tool_name"), *[c for c in ("input_schema", "output_schema") if c in tools.columns])
    props = both_properties(named, [*keys, "tool_name"])
    own = F.element_at(F.split("path", r"\."), -1)
    loose = F.lower(own).isin(*PATH_NAMES) & (_field("type") == "string")
    of_input = F.col("schema") == "input"
    writes = F.greatest(*[F.contains(F.lower("tool_name"), F.lit(x)) for x in WRITING_NAMES])
    return _findings(
        props,
        keys,
        ("unconstrained path", F.when(writes, "medium").otherwise("low"), of_input & loose & ~(_has("pattern") & _has("format"))),
        ("unconstrained path", "low", ~of_input & loose & ~_has("pattern")),
    )


def unbounded_strings(tools: DataFrame, keys: list[str]) -> DataFrame:
    """R114: string properties without any constraint."""
    loose = (_field("type") == "string") & ~F.greatest(*[_has(c) for c in CONSTRAINTS])
    return _findings(both_properties(tools, keys), keys, ("unbounded string", "low", loose))


def tool_texts(tools: DataFrame, keys: list[str]) -> DataFrame:
    """keys, source, text: the name, the description, both schemas, and each string default of the input schema."""
    whole = [F.struct(F.lit(x).alias("source"), F.coalesce(F.col(x), F.lit("")).alias("text")) for x in ("name", "description", "input_schema", "output_schema")]
    whole = tools.select(*keys, F.explode(F.array(*whole)).alias("t")).select(*keys, "t.*")
    # A default that is no string is written without quotes in the node's text.
    is_string = F.col("node").rlike(r'"default": "')
    defaults = schema_properties(tools, keys).where(is_string & _has("default"))
    return whole.unionByName(defaults.select(*keys, F.concat(F.lit("input.default."), "path").alias("source"), _field("default").alias("text")))


#: Names of properties whose change may open a door.
SECURITY_NAMES = (
    "command", "cmd", "script", "code", "eval", "exec", "shell", "sql", "query", "expression", "template",
    "url", "path", "file", "filename", "key", "token", "password", "secret", "credential", "auth",
)
#: Keywords by how a greater value, or a value more, changes what a schema allows.
UPPER = ("maximum", "exclusiveMaximum", "maxLength", "maxItems", "maxProperties")
LOWER = ("minimum", "exclusiveMinimum", "minLength", "minItems", "minProperties")
FIXED = ("pattern", "format", "const")
SETS = ("enum", "type")
LEVELS = {"cosmetic": 0, "behavioral": 1, "security": 2}


def _values(node: str, name: str) -> Column:
    """The members of a keyword's value, itself if it is no array; null where it is absent."""
    text = F.get_json_object(node, f"$.{name}")
    return F.when(text.startswith("["), F.from_json(text, "array<string>")).when(text.isNotNull(), F.array(text))


def _directions() -> tuple[Column, Column]:
    """Keywords of ``old`` and ``new`` that allow more in the new one, and those that allow less.

    A keyword that is absent allows all, so that its removal loosens and its addition tightens.
    """
    was = lambda name: F.get_json_object("old", f"$.{name}")
    now = lambda name: F.get_json_object("new", f"$.{name}")
    ways: list[tuple[str, Column, Column]] = []
    for names, sign in ((UPPER, 1), (LOWER, -1)):
        for name in names:
            a, b = (F.coalesce(x.try_cast("double") * sign, F.lit(float("inf"))) for x in (was(name), now(name)))
            ways.append((name, b > a, b < a))
    for name in FIXED:
        changed = ~was(name).eqNullSafe(now(name))
        ways.append((name, changed & was(name).isNotNull(), changed & now(name).isNotNull()))
    for name in SETS:
        a, b = _values("old", name), _values("new", name)
        beyond = lambda x, y: x.isNotNull() & F.coalesce(F.size(F.array_except(y, x)) > 0, F.lit(True))
        ways.append((name, beyond(a, b), beyond(b, a)))
    a, b = (F.coalesce(_values(x, "required"), F.array().cast("array<string>")) for x in ("old", "new"))
    ways.append(("required", F.size(F.array_except(a, b)) > 0, F.size(F.array_except(b, a)) > 0))
    level = lambda x: F.when(x == "false", 0).when(x.startswith("{"), 1).otherwise(2)
    a, b = level(F.coalesce(was("additionalProperties"), F.lit("true"))), level(F.coalesce(now("additionalProperties"), F.lit("true")))
    ways.append(("additionalProperties", b > a, b < a))
    a, b = (F.coalesce(x("uniqueItems") == "true", F.lit(False)) for x in (was, now))
    ways.append(("uniqueItems", a & ~b, b & ~a))
    ways = sorted(ways, key=lambda w: w[0])
    pick = lambda k: F.array_compact(F.array(*[F.when(w[k], w[0]) for w in ways]))
    return pick(1), pick(2)


def schema_changes(old: DataFrame, new: DataFrame, keys: list[str], column: str = "input_schema") -> DataFrame:
    """Properties that were added, removed or changed between two versions of each schema, with what the change means.

    ``severity`` is cosmetic where only what documents a property changed, security for the names that hold commands, places
    and secrets, else behavioral. ``loosened`` and ``tightened`` list the keywords of a changed property that allow more and less than before,
    and ``weight`` orders changes: security before behavioral, and there what was removed or loosened before what was added or tightened.
    Properties below a limit of the walk are not compared.
    """
    a = schema_properties(old, keys, column).where("not limited").select(*keys, "path", F.col("node").alias("old"))
    b = schema_properties(new, keys, column).where("not limited").select(*keys, "path", F.col("node").alias("new"))
    a, b = (x.dropDuplicates([*keys, "path"]) for x in (a, b))
    both = a.join(b, [*keys, "path"], "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    both = both.withColumn("alike", semantic_json("old").eqNullSafe(semantic_json("new")))
    op = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    leaf = F.lower(F.element_at(F.split("path", r"\."), -1))
    severity = F.when(F.col("alike"), "cosmetic").when(leaf.isin(*SECURITY_NAMES), "security").otherwise("behavioral")
    compared = F.col("old").isNotNull() & F.col("new").isNotNull()
    loosened, tightened = (F.when(compared, x).otherwise(F.array().cast("array<string>")) for x in _directions())
    rows = both.select(*keys, "path", op.alias("op"), severity.alias("severity"), loosened.alias("loosened"), tightened.alias("tightened"))
    opened = (F.col("op") == "removed") | (F.size("loosened") > 0)
    weight = 2 * F.when(F.col("severity") == "security", 2).when(F.col("severity") == "behavioral", 1).otherwise(0) + opened.cast("int")
    return rows.withColumn("weight", F.when(F.col("severity") == "cosmetic", 0).otherwise(weight))


def schema_severity(old: DataFrame, new: DataFrame, keys: list[str], column: str = "input_schema") -> DataFrame:
    """keys and the severity of the change of each schema that both have and that is not the same text.

    Security where a limit of the walk is exceeded; else the worst of its properties; behavioral where none differs but the schema does, or where
    one of the two is no object; else cosmetic.
    """
    pairs = old.select(*keys, F.col(column).alias("_old")).join(new.select(*keys, F.col(column).alias("_new")), keys).where(~F.col("_old").eqNullSafe(F.col("_new")))
    is_object = lambda c: F.coalesce(semantic_json(c).startswith("{"), F.lit(False))
    whole = pairs.select(*keys, (is_object("_old") & is_object("_new")).alias("objects"), semantic_json("_old").eqNullSafe(semantic_json("_new")).alias("alike"))
    level = F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair])
    worst = schema_changes(old, new, keys, column).groupBy(*keys).agg(F.max(level[F.col("severity")]).alias("worst"))
    limits = schema_properties(old, keys, column).unionByName(schema_properties(new, keys, column)).where("limited").select(*keys).distinct().withColumn("limit", F.lit(True))
    rows = whole.join(worst, keys, "left").join(limits, keys, "left")
    severity = (
        F.when(~F.col("objects"), "behavioral").when(F.coalesce("limit", F.lit(False)), "security").when(F.col("worst") == 2, "security")
        .when((F.col("worst") == 1) | ~F.col("alike"), "behavioral").otherwise("cosmetic")
    )
    return rows.select(*keys, severity.alias("severity"))
