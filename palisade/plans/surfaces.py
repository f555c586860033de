"""Queries of surfaces, predicates, line rules and rule sets over the tables, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import rules, surfaces
from ..sources import adapters as A
from ..sources.adapters import with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_VERBS = ("get", "list", "run", "Read", "update", "search")
_NAME = f"[{', '.join(repr(x) for x in _VERBS)}][p_partkey % 6 + 1] || '_' || replace(p_name, ' ', '_')"
_WORDS = " OR ".join(f"contains(lower(d), '{w}')" for w in surfaces.WRITING_WORDS)
_IN_NAME = " OR ".join(f"contains(lower(n), '{w}')" for w in surfaces.WRITING_WORDS)


def _verbs(spark, d):
    verb = F.element_at(F.array(*[F.lit(x) for x in _VERBS]), (F.col("p_partkey") % 6 + 1).cast("int"))
    text = F.when(F.col("p_size") % 4 == 0, F.concat("p_type", F.lit(" and Remove it"))).otherwise(F.col("p_type"))
    return A.table(spark, d, "part").select("p_partkey", F.concat(verb, F.lit("_"), F.regexp_replace("p_name", " ", "_")).alias("name"), text.alias("description"))


@query("ref056_safe_tools", f"""WITH t AS (SELECT p_partkey, {_NAME} AS n, p_type || CASE WHEN p_size % 4 = 0 THEN ' and Remove it' ELSE '' END AS d FROM part)
SELECT p_partkey, regexp_matches(n, '{surfaces.READING_NAME}') AND NOT ({_WORDS}) AND NOT ({_IN_NAME}) AS safe, {_WORDS} OR {_IN_NAME} AS writes FROM t""")
def safe_tools(spark, d):
    return _verbs(spark, d).select("p_partkey", surfaces.is_safe_tool().alias("safe"), surfaces.is_write_tool().alias("writes"))


@query("ref061_surfaces", """SELECT o_orderkey AS scan_id, 'server_instructions' AS surface, CAST(o_custkey AS VARCHAR) AS name, o_orderpriority AS description FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT l_orderkey, 'tool', p_name, p_type FROM lineitem JOIN part ON l_partkey = p_partkey
UNION ALL SELECT l_orderkey, 'prompt', p_brand, '' FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber = 1
UNION ALL SELECT l_orderkey, 'resource', 'uri:' || l_suppkey, l_returnflag FROM lineitem WHERE l_linenumber = 2
UNION ALL SELECT l_orderkey, 'resource_template', l_linestatus, l_returnflag FROM lineitem WHERE l_linenumber = 3""")
def pseudo_tools(spark, d):
    """All that a scan of an order holds: its parts as tools, and other surfaces from its lines."""
    line = A.table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "scan_id")
    parts = line.join(A.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    none = F.lit(None).cast("string")
    scans = A.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("scan_id"), F.col("o_custkey").cast("string").alias("target"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("instructions"),
    )
    found = surfaces.pseudo_tools(
        scans,
        parts.select("scan_id", F.col("p_name").alias("name"), F.col("p_type").alias("description"), none.alias("input_schema"), none.alias("output_schema")),
        parts.where("l_linenumber = 1").select("scan_id", F.col("p_brand").alias("name"), none.alias("description")),
        line.where("l_linenumber = 2").select("scan_id", F.lit("").alias("name"), F.concat(F.lit("uri:"), F.col("l_suppkey").cast("string")).alias("uri"), F.col("l_returnflag").alias("description")),
        line.where("l_linenumber = 3").select("scan_id", F.col("l_linestatus").alias("name"), F.lit("t").alias("uri_template"), F.col("l_returnflag").alias("description")),
    )
    return found.select("scan_id", "surface", "name", "description")


@query("ref059_server_packages", """WITH p AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'Red-MCP-sdk' WHEN 1 THEN 'blue-server-adapter' WHEN 2 THEN 'plain-' || p_size WHEN 3 THEN 'metaharness' ELSE 'x-mcp' END AS n, p_size FROM part)
SELECT id, lower(n) <> 'metaharness' AND (p_size % 2 = 0 OR contains(lower(n), 'mcp') OR contains(n, 'server')) AND (contains(n, 'server') OR NOT contains(n, 'sdk')) AS server FROM p""")
def server_packages(spark, d):
    k = F.col("p_partkey") % 5
    name = F.when(k == 0, "Red-MCP-sdk").when(k == 1, "blue-server-adapter").when(k == 2, F.concat(F.lit("plain-"), F.col("p_size").cast("string"))).when(k == 3, "metaharness").otherwise("x-mcp")
    words = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("MCP-Server")))
    return A.table(spark, d, "part").select(F.col("p_partkey").alias("id"), name.alias("name"), words.alias("keywords")).select("id", surfaces.is_server_package().alias("server"))


@query("ref065_coverage", f"""{with_views("findings")}, s AS (SELECT o_orderkey AS k, o_orderstatus = 'O' AS live FROM orders),
c AS (SELECT s.k, live, count(f.scan_id) AS n FROM s LEFT JOIN findings f ON f.scan_id = k AND f.severity = 'critical' GROUP BY 1, 2)
SELECT count(*) FILTER (live) || ' live, ' || count(*) FILTER (NOT live AND n > 0) || ' package-only, ' || count(*) FILTER (NOT live AND n = 0) || ' incomplete' AS summary FROM c""")
def coverage(spark, d):
    """Coverage of every order's scan (065), and their counts in one line (126)."""
    found = A.findings(spark, d).where("severity = 'critical'").groupBy("scan_id").agg(F.count("*").alias("n"))
    rows = A.table(spark, d, "orders").join(found, F.col("o_orderkey") == F.col("scan_id"), "left")
    rows = rows.select(surfaces.coverage(F.col("o_orderstatus") == "O", F.coalesce("n", F.lit(0))).alias("coverage"))
    return surfaces.coverage_summary(rows)


@query("ref066_embedded_json", """SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE '{"name": "' || c_name || '", "n": {"m": ' || c_nationkey || '}}' END AS object FROM customer""")
def embedded_json(spark, d):
    body = F.concat(F.lit('{"name": "'), "c_name", F.lit('", "n": {"m": '), F.col("c_nationkey").cast("string"), F.lit("}}"))
    k = F.col("c_custkey") % 4
    text = F.when(k == 0, "[1, 2] {broken").when(k == 1, body).when(k == 2, F.concat(F.lit("log {x} line\n"), body, F.lit(" {} done"))).otherwise(F.concat(F.lit("{"), body))
    return A.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), surfaces.embedded_json(text).alias("object"))


@query("ref125_languages", """SELECT ['python', 'javascript', 'typescript'][p_partkey % 4 + 1] AS language, count(*) AS files FROM part WHERE p_partkey % 4 < 3 GROUP BY 1""")
def languages(spark, d):
    k = F.col("p_partkey") % 4
    path = F.concat(F.lit("src/"), "p_name", F.when(k == 0, ".py").when(k == 1, ".MJS").when(k == 2, ".tsx").otherwise(".txt"))
    return surfaces.files_by_language(A.table(spark, d, "part").select(path.alias("path")))


@query("ref128_vulnerable_packages", """SELECT count(DISTINCT l_partkey) AS packages FROM lineitem WHERE l_quantity > 40""")
def vulnerable_packages(spark, d):
    detail = F.when(F.col("l_quantity") > 40, F.concat(F.lit('{"package":"p'), F.col("l_partkey").cast("string"), F.lit('"}'))).otherwise("{}")
    return surfaces.vulnerable_packages(A.table(spark, d, "lineitem").select(detail.alias("detail")))


_LINE_ENDS = "chr(13) || chr(10) || '|[' || chr(10) || chr(13) || '\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]'"
_HIDDEN = "[\\x{202A}-\\x{202E}\\x{2066}-\\x{2069}\\x{200B}-\\x{200F}\\x{2060}\\x{FEFF}]"


@query("ref177_hidden_lines", f"""WITH f AS (SELECT 'd' || doc_id AS path, text AS content FROM documents
  UNION ALL SELECT 'm' || doc_id, replace(text, chr(10), CASE WHEN doc_id % 2 = 0 THEN chr(8238) ELSE '' END || chr(8203) || chr(10)) FROM documents),
l AS (SELECT path, unnest(string_split_regex(content, {_LINE_ENDS})) AS line, generate_subscripts(string_split_regex(content, {_LINE_ENDS}), 1) AS line_number FROM f)
SELECT path, CAST(line_number AS INT) AS line_number, array_to_string(list_transform(list_sort(list_distinct(regexp_extract_all(line, '{_HIDDEN}'))), lambda c: 'U+' || printf('%04X', unicode(c))), ', ') AS chars,
  CASE WHEN regexp_matches(line, '[\\x{{202A}}-\\x{{202E}}\\x{{2066}}-\\x{{2069}}]') THEN 'high' ELSE 'medium' END AS severity FROM l WHERE regexp_matches(line, '{_HIDDEN}')""")
def hidden_lines(spark, d):
    """Every line of every document as it is, and of a twin of each document with one or two hidden characters at its line ends."""
    docs = A.table(spark, d, "documents").where("text is not null")
    own = F.col("doc_id").cast("string")
    mark = F.concat(F.when(F.col("doc_id") % 2 == 0, chr(0x202E)).otherwise(""), F.lit(chr(0x200B) + "\n"))
    plain = docs.select(F.concat(F.lit("d"), own).alias("path"), F.col("text").alias("content"))
    marked = docs.select(F.concat(F.lit("m"), own).alias("path"), F.replace("text", F.lit("\n"), mark).alias("content"))
    return surfaces.hidden_lines(plain.unionByName(marked))


_CATEGORY = "CASE " + " ".join(f"WHEN contains(lower(n), '{a}') THEN '{b}'" for a, b in surfaces.CATEGORIES) + " ELSE 'Other' END"


@query("ref216_categories", f"""WITH s AS (SELECT p_partkey AS id, [{", ".join(f"'{a}'" for a, _ in surfaces.CATEGORIES)}][p_partkey % 40 + 1] AS k, p_name FROM part),
t AS (SELECT id, upper(coalesce(k, 'local')) || '-' || p_name AS n FROM s), c AS (SELECT id, n, {_CATEGORY} AS category FROM t)
SELECT id, category, category IN ({", ".join(f"'{x}'" for x in surfaces.FREE_CATEGORIES)}) OR {" OR ".join(f"contains(lower(n), '{x}')" for x in surfaces.FREE_PARTS)} AS api_free FROM c""")
def categories(spark, d):
    words = F.array(*[F.lit(a) for a, _ in surfaces.CATEGORIES])
    word = F.coalesce(F.get(words, (F.col("p_partkey") % 40).cast("int")), F.lit("local"))
    rows = A.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.upper(word), F.lit("-"), "p_name").alias("name"))
    return rows.select("id", surfaces.category().alias("category"), surfaces.is_api_free().alias("api_free"))


@query("ref226_since", """SELECT count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01' - INTERVAL 90 DAY""")
def since(spark, d):
    start = surfaces.cutoff("90d", F.lit("2000-01-01").cast("timestamp"))
    return A.table(spark, d, "orders").where(F.col("o_orderdate") >= start).agg(F.count("*").alias("n"))


@query("ref227_certificates", """SELECT o_orderkey AS id, o_orderkey % 3 <> 0 AND o_orderdate > TIMESTAMP '1998-01-01' AS valid FROM orders""")
def certificates(spark, d):
    text = F.concat(F.date_format("o_orderdate", "MMM  d HH:mm:ss yyyy"), F.lit(" GMT"))
    rows = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, "soon").otherwise(text).alias("not_after"))
    return rows.select("id", surfaces.certificate_valid(now=F.lit("1998-01-01").cast("timestamp")).alias("valid"))


@query("ref230_arguments", """SELECT p_partkey AS id, '{"list": [' || CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE '' END || '], "mode": "' || p_brand || '", "n": 0, "other": "test"}' AS arguments FROM part""")
def arguments(spark, d):
    items = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit('"items":{"default":'), F.col("p_size").cast("string"), F.lit("}"))).otherwise('"items":{}')
    schema = F.concat(
        F.lit('{"required":["n","mode","list","other","missing"],"properties":{"n":{"type":"integer"},"free":{"type":"string"},"other":{},"mode":{"default":"'),
        "p_brand", F.lit('"},"list":{"type":"array",'), items, F.lit("}}}"),
    )
    return A.table(spark, d, "part").select(F.col("p_partkey").alias("id"), surfaces.synthesized_arguments(schema).alias("arguments"))


@query("ref250_rule_set", f"""{with_views("tools")} SELECT rule_id, severity, count(*) AS n FROM (
  SELECT 'X001' AS rule_id, 'low' AS severity FROM tools WHERE length(name) > 10 UNION ALL
  SELECT 'R001', 'critical' FROM tools WHERE lower(name) IN ({", ".join(f"'{n}'" for n in rules.DANGEROUS_NAMES)})) GROUP BY 1, 2""")
def rule_set(spark, d):
    """A rule of the library and one of another, a third disabled (250, 251)."""
    found = surfaces.RuleSet()
    found.register("R001", "dangerous names", lambda tools: rules.dangerous_names(tools).withColumn("evidence", F.col("name")))
    long_name = lambda tools: tools.where(F.length("name") > 10).select("server", "name", F.lit("low").alias("severity"), F.col("name").alias("evidence"))
    found.register("X001", "long names", long_name)
    found.register("X002", "all names", lambda tools: tools.select("server", "name", F.lit("low").alias("severity"), F.col("name").alias("evidence")))
    found.disable("X002")
    return found.run(A.tools(spark, d)).groupBy("rule_id", "severity").agg(F.count("*").alias("n"))


_SCRIPT = "\neval(x); eval(y)\nspawn(cmd, 'a')\nconst u = 'http://169.254.169.254/'\nreturn await fetch(\nurl)\nserver.listen('0.0.0.0')\nfetch( 'x')\nfetch('y')"
#: The rules for SQL: a look-ahead behind blanks that may be given back is any character but a quote, or the end.
_SCRIPT_SQL = [
    (rule, severity, re.sub(r"\\s\*\(\?!\[(.*?)\]\)", r"(?:[^\1]|\\z)", re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", p))) for rule, severity, p in surfaces.SCRIPT_RULES
]


@query("ref181_script_findings", "WITH f AS (SELECT 'd' || doc_id || '.ts' AS path, text AS content FROM documents UNION ALL SELECT 'm' || doc_id || '.ts', text || '" + _SCRIPT.replace("'", "''") + "' FROM documents),\nr AS ("
+ " UNION ALL ".join(
    f"SELECT path, '{rule}' AS rule_id, '{severity}' AS severity, unnest(list_transform(string_split_regex(content, '{(p := pattern.replace(chr(39), chr(39) * 2))}'), lambda x: len(string_split(x, chr(10))) - 1)) AS b,"
    f" unnest(list_append(list_transform(regexp_extract_all(content, '{p}'), lambda x: len(string_split(x, chr(10))) - 1), NULL)) AS w, generate_subscripts(string_split_regex(content, '{p}'), 1) AS i FROM f"
    for rule, severity, pattern in _SCRIPT_SQL
)
+ ")\nSELECT DISTINCT path, CAST(line AS INT) AS line_number, rule_id, severity FROM (SELECT *, 1 + sum(b) OVER (PARTITION BY path, rule_id ORDER BY i) + coalesce(sum(w) OVER (PARTITION BY path, rule_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM r) WHERE w IS NOT NULL")
def script_findings(spark, d):
    """Every document as it is, and a twin of each before lines that the rules report."""
    docs = A.table(spark, d, "documents").where("text is not null")
    path = lambda kind: F.concat(F.lit(kind), F.col("doc_id").cast("string"), F.lit(".ts")).alias("path")
    plain = docs.select(path("d"), F.col("text").alias("content"))
    return surfaces.script_findings(plain.unionByName(docs.select(path("m"), F.concat("text", F.lit(_SCRIPT)).alias("content"))))


_BINDS = "\nmcp.run(host=\"0.0.0.0\")\n# host='0.0.0.0'\ns.bind(('', 80))\nmcp.settings.host = '::'\nrun(host='127.0.0.1')\nhost='0.0.0.0\""
#: The pattern for SQL: one alternative for each quote.
_BIND_SQL = "|".join(surfaces.OPEN_BIND.replace("(['\"])", q).replace("\\1", q) for q in ("''", '"'))


@query("ref178_open_binds", f"""WITH f AS (SELECT 'd' || doc_id || '.py' AS path, text AS content FROM documents UNION ALL SELECT 'm' || doc_id || '.py', text || '{_BINDS.replace("'", "''")}' FROM documents),
l AS (SELECT path, unnest(string_split_regex(content, '\\r\\n|[\\n\\r]')) AS line, generate_subscripts(string_split_regex(content, '\\r\\n|[\\n\\r]'), 1) AS line_number FROM f)
SELECT path, CAST(line_number AS INT) AS line_number, 'S009' AS rule_id, 'high' AS severity FROM l WHERE regexp_matches(line, '{_BIND_SQL}') AND NOT regexp_matches(line, '^\\s*#')""")
def open_binds(spark, d):
    """Every document as it is, and a twin of each before lines that bind and lines that do not."""
    docs = A.table(spark, d, "documents").where("text is not null")
    path = lambda kind: F.concat(F.lit(kind), F.col("doc_id").cast("string"), F.lit(".py")).alias("path")
    plain = docs.select(path("d"), F.col("text").alias("content"))
    return surfaces.open_binds(plain.unionByName(docs.select(path("m"), F.concat("text", F.lit(_BINDS)).alias("content"))))


@query("ref229_arguments", """WITH p AS (SELECT p_partkey AS id, p_partkey % 5 AS k, p_name AS n FROM part)
SELECT id, CASE k WHEN 0 THEN 'forbidden: a' WHEN 1 THEN 'too long: l[1]' WHEN 2 THEN 'too deep: d' WHEN 3 THEN 'no object' END AS fault,
  CASE k WHEN 0 THEN '{"a": "test", "n": "' || n || '"}' WHEN 1 THEN '{"l": [1, "' || repeat('x', 50) || '"], "n": "' || n || '"}' WHEN 2 THEN '{"a": {"b": {"c": {}}}, "n": "' || n || '"}'
  WHEN 3 THEN '{}' ELSE '{"n": "' || n || '"}' END AS cleaned FROM p""")
def argument_checks(spark, d):
    k = F.col("p_partkey") % 5
    first = F.when(k == 0, '"a":"Root",').when(k == 1, f'"l":[1,"{"x" * 60}"],').when(k == 2, '"a":{"b":{"c":{"d":{}}}},').otherwise("")
    text = F.when(k == 3, "[1]").otherwise(F.concat(F.lit("{"), first, F.lit('"n":"'), "p_name", F.lit('"}')))
    rows = A.table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.alias("args"))
    return rows.select("id", surfaces.argument_faults("args").alias("fault"), surfaces.cleaned_arguments("args").alias("cleaned"))


@query("ref062_registry_stubs", """SELECT '@a/' || p_name AS name, CAST(min_by(p_size, p_partkey) AS VARCHAR) AS version, 'registry-pending' AS status,
  min_by(p_type, p_partkey) AS description, 'a-' || p_name || '.json' AS file FROM part GROUP BY p_name""")
def registry_stubs(spark, d):
    none = F.lit(None).cast("string")
    rows = A.table(spark, d, "part").select(
        F.col("p_partkey").alias("position"), F.concat(F.lit("@a/"), "p_name").alias("name"), F.col("p_size").cast("string").alias("version"),
        F.col("p_type").alias("description"), none.alias("repository"),
    )
    return surfaces.registry_stubs(rows).select("name", "version", "status", "description", "file")


@query("ref063_registry_metadata", """SELECT s_suppkey AS id, '{"$schema":"https://static.modelcontextprotocol.io/schemas/2025-12-11/server.schema.json","name":"'
  || ['io.modelcontextprotocol/', 'com.microsoft.playwright/', 'io.github.x/'][s_suppkey % 3 + 1] || s_name || '","version":"' || CASE WHEN s_suppkey % 2 = 0 THEN 'unknown' ELSE '1.0' END
  || '","_meta":{"io.github.palisade/security":{"grade":"A","risk_score":' || CASE WHEN s_suppkey % 4 = 0 THEN 'null' ELSE CAST(s_nationkey AS VARCHAR) END || '}}}' AS entry FROM supplier""")
def registry_metadata(spark, d):
    k = F.col("s_suppkey")
    scope = F.when(k % 3 == 0, "@modelcontextprotocol/").when(k % 3 == 1, "@playwright/").otherwise("@x/")
    rows = A.table(spark, d, "supplier").select(
        k.alias("id"), F.concat(scope, "s_name").alias("server"), F.when(k % 2 == 1, "1.0").alias("version"), F.lit("A").alias("grade"),
        F.when(k % 4 != 0, F.col("s_nationkey")).alias("risk_score"),
    )
    found = surfaces.registry_metadata(rows, ["grade", "risk_score"]).join(rows.select("id", "server"), "server")
    return found.select("id", "entry")
