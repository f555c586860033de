"""Version order and version ranges against plain Python."""

import json
import random
import re

import pytest
from packaging.version import Version
from pyspark.sql import functions as F

from palisade.functions.versions import version_key
from palisade.operators import advisories
from palisade.sources import readers


def semantic(text):
    """What semantic versions are sorted by."""
    text = text.lower().lstrip("v=").split("+")[0]
    release, _, pre = text.partition("-")
    numbers = [int(x) for x in release.split(".")]
    while len(numbers) > 1 and not numbers[-1]:
        numbers.pop()
    parts = [(0, int(x), "") if x.isdigit() else (1, 0, x) for x in pre.split(".")] if pre else []
    return numbers, not pre, parts


def versions(rnd, kind):
    found = set()
    while len(found) < 250:
        release = ".".join(str(rnd.choice([0, 0, 1, 2, 9, 10, 11, 100, 20240101])) for _ in range(rnd.randint(1, 4)))
        if kind == "npm":
            release += rnd.choice(["", "", "-alpha", "-alpha.1", "-alpha.beta", "-beta.2", "-beta.11", "-rc.1", "-0", "-1.x", "-alpha-1"])
        else:
            release = rnd.choice(["", "", "1!"]) + release + rnd.choice(["", "", "a1", "b2", "rc1", "rc10", ".dev3", ".post1", "c2", "-beta4"])
        found.add(release)
    return sorted(found)


@pytest.mark.parametrize("kind", ["npm", "PyPI"])
def test_keys_sort_as_versions_do(spark, kind):
    texts = versions(random.Random(3), kind)
    order = semantic if kind == "npm" else Version
    got = {r["v"]: r["k"] for r in spark.createDataFrame([(v,) for v in texts], "v string").select("v", version_key(F.col("v"), F.lit(kind)).alias("k")).collect()}
    for a in texts:
        for b in texts:
            assert (got[a] < got[b]) == (order(a) < order(b)), (a, b, got[a], got[b])
            assert (got[a] == got[b]) == (order(a) == order(b)), (a, b)


def test_keys_of_odd_versions(spark):
    rows = [("v1.2.3",), ("=1.2.3+build.5",), (" 1.2.3 ",), ("001.2.3.0",), ("latest",), ("",), (None,), ("9" * 40,), ("1.0~x",)]
    got = [r[0] for r in spark.createDataFrame(rows, "v string").coalesce(1).select(version_key(F.col("v"), F.lit("npm"))).collect()]
    assert got[0] == got[1] == got[2] == got[3] and got[4:7] == [None] * 3 and got[7] > got[0] and got[8] is not None


def advisory(i, package, ecosystem, ranges, listed=(), **more):
    events = [{"type": kind, "events": [dict([e]) for e in es]} for kind, es in ranges]
    return json.dumps({"id": i, "affected": [{"package": {"name": package, "ecosystem": ecosystem}, "ranges": events, "versions": list(listed)}], **more})


def test_ranges_equal_brute_force(spark):
    rnd = random.Random(11)
    pool = versions(rnd, "npm")
    order = {v: semantic(v) for v in pool}
    raw, held = [], []
    for i in range(60):
        package, events, opened = rnd.choice(["hot", "hot", "p1", "P2"]), [], []
        cuts = sorted(rnd.sample(pool, rnd.choice([1, 2, 3, 4])), key=lambda v: order[v])
        for n, cut in enumerate(cuts):
            if n % 2 == 0:
                low = "0" if n == 0 and rnd.random() < 0.3 else cut
                events.append(("introduced", low))
                opened.append([None if low == "0" else order[low], None, False])
            else:
                closed = rnd.random() < 0.4
                if order[cut] == opened[-1][0] and not closed:
                    continue
                events.append(("last_affected" if closed else "fixed", cut))
                opened[-1][1:] = [order[cut], closed]
        rnd.shuffle(events)
        listed = rnd.sample(pool, 2)
        raw.append(advisory(f"A{i}", package, "npm", [(rnd.choice(["SEMVER", "ECOSYSTEM"]), events), ("GIT", [("introduced", "0")])], listed))
        held.append((f"A{i}", package.lower(), opened, [order[v] for v in listed]))
    rows = [(n, "NPM", rnd.choice(["hot", "HOT", "p1", "p2", "none"]), rnd.choice(pool)) for n in range(400)]
    rows += [(900, "npm", "hot", "latest"), (901, "npm", None, "1.0.0"), (902, None, "hot", "1.0.0"), (903, "npm", "hot", None)]
    want = set()
    for n, _, name, text in rows[:400]:
        at = order[text]
        for i, package, opened, listed in held:
            inside = any((low is None or low <= at) and (high is None or at < high or (closed and at == high)) for low, high, closed in opened)
            if package == name.lower() and (inside or at in listed):
                want.add((n, i))
    ranges = advisories.advisory_ranges(spark.createDataFrame([(x,) for x in [*raw, "{broken", None, '{"id":"B"}']], "text string"))
    deps = spark.createDataFrame(rows, "n long, ecosystem string, name string, version string").repartition(3)
    got = [(r["n"], r["id"]) for r in advisories.vulnerable_dependencies(deps, ranges).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert advisories.vulnerable_dependencies(deps.limit(0), ranges).count() == 0
    assert advisories.vulnerable_dependencies(deps, ranges.limit(0)).count() == 0


def test_findings_tell_the_fix(spark):
    raw = spark.createDataFrame(
        [
            (advisory("G-1", "My_Pkg", "PyPI", [("ECOSYSTEM", [("introduced", "0"), ("fixed", "2.0")])], aliases=["GHSA", "CVE-7"], summary="bad", severity=[{"type": "CVSS_V3", "score": "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"}]),),
            (advisory("G-2", "my-pkg", "pypi", [("SEMVER", [("introduced", "1.0rc1")])]),),
        ],
        "text string",
    )
    deps = spark.createDataFrame([("PyPI", "my.pkg", "1.0rc2", "req.txt"), ("PyPI", "my.pkg", "2.0", "req.txt")], "ecosystem string, name string, version string, source string")
    found = advisories.dependency_findings(advisories.vulnerable_dependencies(deps, advisories.advisory_ranges(raw)), readers.advisory_rows(raw))
    got = sorted((r["target"], r["description"], r["severity"], r["detail"]["fixed_version"], r["source"]) for r in found.collect())
    assert got == [
        ("my.pkg@1.0rc2", "my.pkg@1.0rc2 (PyPI) is affected by CVE-7: bad; fixed in 2.0", "critical", "2.0", "req.txt"),
        ("my.pkg@1.0rc2", "my.pkg@1.0rc2 (PyPI) is affected by G-2: G-2", "medium", None, "req.txt"),
        ("my.pkg@2.0", "my.pkg@2.0 (PyPI) is affected by G-2: G-2", "medium", None, "req.txt"),
    ]
    assert not re.search("Cartesian|NestedLoop", found._jdf.queryExecution().executedPlan().toString())


def test_manifests_are_parsed_once_and_by_many_tasks(spark, sf_dir):
    """A file of parts was one task, which parsed every manifest once for its locks and once for its rows."""
    from palisade.plans import registry

    for name in ("ref015_pnpm_locks", "ref018_pyprojects", "ref019_python_locks", "ref040_sbom", "ref040_sbom_edges"):
        plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInPandas") == (2 if name == "ref040_sbom_edges" else 1)
        assert "Repartition" in plan, name
    for name in ("ref201_schema_nodes", "ref205_schema_severity"):
        assert "Repartition" in registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


def test_versions_are_told_once(spark):
    """However many dependencies have a version, its advisories are found once; all of the dependencies meet them."""
    from palisade.operators import advisories

    deps = spark.createDataFrame([(i, "npm", "a", "1.0.0") for i in range(5)] + [(9, "npm", "a", "2.0.0"), (10, None, "a", "1.0.0"), (11, "npm", "a", None)], "scan_id long, ecosystem string, name string, version string")
    text = '{"id":"A","affected":[{"package":{"name":"a","ecosystem":"npm"},"ranges":[{"type":"SEMVER","events":[{"introduced":"0"},{"fixed":"1.5.0"}]}]}]}'
    ranges = advisories.advisory_ranges(spark.createDataFrame([(text,)], "text string"))
    assert [tuple(r) for r in advisories.vulnerable_versions(deps, ranges).collect()] == [("npm", "a", "1.0.0", "A", "1.5.0")]
    assert sorted(r["scan_id"] for r in advisories.vulnerable_dependencies(deps, ranges).collect()) == [0, 1, 2, 3, 4]
