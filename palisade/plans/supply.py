"""Queries of the supply chain: dependencies, advisories and their version ranges, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rows import written_copy
from ..operators import advisories
from ..sources import adapters as A
from ..sources import readers

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


def _dependencies(spark, d):
    """A dependency for every line of an order: a third of one package, one in five a pre-release."""
    python = F.col("l_linenumber") % 2 == 0
    release = F.concat_ws(".", F.col("l_suppkey") % 4, F.col("l_linenumber"), F.col("l_quantity").cast("int") % 3)
    n = (F.col("l_orderkey") % 12).cast("string")
    version = F.when(F.col("l_orderkey") % 5 != 0, release).otherwise(F.concat(release, F.when(python, "rc").otherwise("-rc."), n))
    return A.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("scan_id"),
        F.when(python, "PyPI").otherwise("npm").alias("ecosystem"),
        F.when(F.col("l_partkey") % 3 == 0, "Pkg_Hot").otherwise(F.concat(F.lit("pkg-"), F.col("l_partkey").cast("string"))).alias("name"),
        version.alias("version"),
    )


def _advisories(spark, d):
    """JSON text of an advisory for every part, eight of them of the hot package: a range, at times open, and for some a second one that ends inside."""
    size, i = F.col("p_size"), F.col("p_partkey")
    hot = (i % 50 < 2) & (i <= 200)
    python = F.when(hot, i % 50 == 0).otherwise(i % 2 == 0)
    name = F.when(hot, F.when(python, "pkg.hot").otherwise("pkg_hot")).otherwise(F.concat(F.lit("pkg-"), i.cast("string")))
    opened = F.concat_ws(".", size % 4, size % 7, F.lit(0))
    rc = F.when(python, "rc").otherwise("-rc.")
    first = F.concat(F.lit('{"type":"SEMVER","events":[{"introduced":"'), opened, F.lit('"}'), F.when(size % 5 == 0, "").otherwise(F.concat(F.lit(',{"fixed":"'), (size % 4 + 1).cast("string"), F.lit('.0.0"}'))), F.lit("]}"))
    second = F.concat(F.lit(',{"type":"ECOSYSTEM","events":[{"introduced":"3.2.0'), rc, F.lit('3"},{"last_affected":"3.4.1"}]},{"type":"GIT","events":[{"introduced":"0"}]}'))
    return A.table(spark, d, "part").select(
        F.concat(
            F.lit('{"id":"A-'), i.cast("string"), F.lit('","summary":"Flaw of '), F.col("p_name"), F.lit('","aliases":["X-1"'), F.when(size % 2 == 0, F.concat(F.lit(',"CVE-'), i.cast("string"), F.lit('"'))).otherwise(""),
            F.lit('],"severity":[{"type":"CVSS_V3","score":"'), F.when(size % 3 == 1, "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H").otherwise(""),
            F.lit('"}],"affected":[{"package":{"name":"'), name, F.lit('","ecosystem":"'), F.when(python, "PyPI").otherwise("npm"), F.lit('"},"ranges":['), first,
            F.when(size % 3 == 0, second).otherwise(""), F.lit('],"versions":["'), F.when(size % 11 == 0, "0.1.2").otherwise("none"), F.lit('"]}]}'),
        ).alias("text")
    )


#: The same dependencies and ranges with versions as lists: three numbers, whether it is a release, the number of the pre-release.
_RANGES = """deps AS (
  SELECT l_orderkey AS scan_id, CASE WHEN l_linenumber % 2 = 0 THEN 'PyPI' ELSE 'npm' END AS ecosystem, CASE WHEN l_partkey % 3 = 0 THEN 'Pkg_Hot' ELSE 'pkg-' || l_partkey END AS name,
    CASE WHEN l_partkey % 3 > 0 THEN 'pkg-' || l_partkey WHEN l_linenumber % 2 = 0 THEN 'pkg-hot' ELSE 'pkg_hot' END AS package,
    (l_suppkey % 4) || '.' || l_linenumber || '.' || (CAST(l_quantity AS INT) % 3)
      || CASE WHEN l_orderkey % 5 <> 0 THEN '' ELSE CASE WHEN l_linenumber % 2 = 0 THEN 'rc' ELSE '-rc.' END || (l_orderkey % 12) END AS version,
    [l_suppkey % 4, l_linenumber, CAST(l_quantity AS INT) % 3, CASE WHEN l_orderkey % 5 <> 0 THEN 1 ELSE 0 END, CASE WHEN l_orderkey % 5 <> 0 THEN 0 ELSE l_orderkey % 12 END]::BIGINT[] AS v
  FROM lineitem),
adv AS (
  SELECT *, CASE WHEN CASE WHEN p_partkey % 50 < 2 AND p_partkey <= 200 THEN p_partkey % 50 = 0 ELSE p_partkey % 2 = 0 END THEN 'PyPI' ELSE 'npm' END AS ecosystem,
    CASE WHEN p_partkey <= 200 AND p_partkey % 50 = 0 THEN 'pkg-hot' WHEN p_partkey <= 200 AND p_partkey % 50 = 1 THEN 'pkg_hot' ELSE 'pkg-' || p_partkey END AS package, 'A-' || p_partkey AS id FROM part),
ranges AS (
  SELECT id, ecosystem, package, [p_size % 4, p_size % 7, 0, 1, 0]::BIGINT[] AS low, CASE WHEN p_size % 5 > 0 THEN [p_size % 4 + 1, 0, 0, 1, 0] ELSE [99] END::BIGINT[] AS high,
    CASE WHEN p_size % 5 > 0 THEN (p_size % 4 + 1) || '.0.0' END AS fix FROM adv
  UNION ALL SELECT id, ecosystem, package, [3, 2, 0, 0, 3], [3, 4, 1, 1, 1], NULL FROM adv WHERE p_size % 3 = 0
  UNION ALL SELECT id, ecosystem, package, [0, 1, 2, 1, 0], [0, 1, 2, 1, 1], NULL FROM adv WHERE p_size % 11 = 0),
hits AS (
  SELECT d.ecosystem, d.package, d.v, r.id, min(r.fix) AS fix FROM (SELECT DISTINCT ecosystem, package, v FROM deps) d
  JOIN ranges r ON r.ecosystem = d.ecosystem AND r.package = d.package AND r.low <= d.v AND d.v < r.high GROUP BY ALL)"""


@query("ref083_vulnerable_versions", f"""WITH {_RANGES}
SELECT d.ecosystem, d.name, d.version, h.id, h.fix, count(*) AS uses FROM deps d JOIN hits h ON h.ecosystem = d.ecosystem AND h.package = d.package AND h.v = d.v GROUP BY ALL""")
def vulnerable_versions(spark, d):
    """Every dependency against the ranges of all advisories: how often each vulnerable version is used."""
    uses = written_copy(_dependencies(spark, d).groupBy(*advisories.VERSION).agg(F.count("*").alias("uses")))
    hits = advisories.vulnerable_dependencies(uses, advisories.advisory_ranges(_advisories(spark, d)))
    return hits.select(*advisories.VERSION, "id", "fix", "uses")


@query("ref186_dependency_findings", f"""WITH {_RANGES}
SELECT d.scan_id, 'D001' AS rule_id, d.name || '@' || d.version AS target, CASE WHEN p.p_size % 3 = 1 THEN 'critical' ELSE 'medium' END AS severity,
  d.name || '@' || d.version || ' (' || d.ecosystem || ') is affected by ' || CASE WHEN p_size % 2 = 0 THEN 'CVE-' || p_partkey ELSE h.id END || ': Flaw of ' || p_name
  || coalesce('; fixed in ' || coalesce(h.fix, CASE WHEN p_size % 5 > 0 THEN (p_size % 4 + 1) || '.0.0' END), '') AS description
FROM deps d JOIN hits h ON h.ecosystem = d.ecosystem AND h.package = d.package AND h.v = d.v JOIN adv p ON p.id = h.id""")
def dependency_findings(spark, d):
    """A finding for every dependency of a vulnerable version and every advisory that holds it."""
    raw = _advisories(spark, d)
    dependencies = _dependencies(spark, d)
    # What is said of a version is the same for all of its dependencies.
    hits = advisories.vulnerable_versions(dependencies, advisories.advisory_ranges(raw))
    said = advisories.dependency_findings(hits, readers.advisory_rows(raw))
    found = dependencies.join(said, advisories.VERSION)
    return found.select("scan_id", "rule_id", "target", "severity", "description")
