"""Small operators that the queries do not reach in every case."""

import pytest
from pyspark.sql import functions as F

from palisade.functions import text
from palisade.operators import lists, policy, posture, scoring
from palisade.sources import sinks


def values(frame):
    return sorted(map(tuple, frame.collect()), key=str)


@pytest.mark.parametrize(
    "severities, servers, tools, risk",
    [([], 0, 0, 0), (["critical"], 1, 5, 25 + 2), (["high", "medium", "low", "odd"], 5, 60, 26 + 10 + 5), (["critical"] * 5, 9, 900, 100), (["low"], 2, 50, 3 + 4 + 10)],
)
def test_cross_risk(spark, severities, servers, tools, risk):
    rows = spark.createDataFrame([(s,) for s in severities], "severity string")
    assert scoring.cross_risk(rows, servers, tools).first()["risk"] == risk


def test_gaps_first_rows_and_thresholds(spark):
    counts = spark.createDataFrame([("a", 3, 3), ("b", 1, 9), ("c", 0, 0)], "rule string, positive long, negative long")
    assert values(policy.evidence_gaps(counts, "rule")) == [("b", 2, 0), ("c", 3, 3)]
    rows = spark.createDataFrame([("r", "t", 2, "late"), ("r", "t", 1, "first"), ("r", None, 3, "null"), (None, "t", 4, "x")], "rule string, target string, n int, text string")
    assert sorted(r["text"] for r in policy.first_of(rows, ["rule", "target"], ["n"]).collect()) == ["first", "null", "x"]
    coverage = spark.createDataFrame([("a", 80, 100), ("b", 80, 100), ("c", 0, 0), ("d", 1, 3)], "module string, covered long, total long")
    own = spark.createDataFrame([("b", 90.0)], "module string, threshold double")
    assert [m for m, _ in values(lists.below_threshold(coverage, own, 50.0))] == ["b", "d"]
    assert lists.below_threshold(coverage.limit(0), own, 50.0).count() == 0


def test_migration_and_typosquats(spark):
    rows = spark.createDataFrame([("a", "2024-11-05", True), ("b", "2025-06-18", True), ("c", "2024-11-05", False), ("d", None, True)], "target string, protocol_version string, uses_session boolean")
    assert values(posture.migration_issues(rows)) == [("a", "session")]
    near = spark.createDataFrame([("mcp-servr-git", "mcp-server-git", 1)], "name string, suspected string, distance int")
    assert values(posture.typosquat_findings(near)) == [("mcp-servr-git", "T001", "high", "close to mcp-server-git")]


def test_exports_of_rows(spark, tmp_path):
    rows = spark.createDataFrame([("R1", "high", 'a "b", c', "s", "t", "x.py:1", 1), ("R2", "low", "p|q", None, "t", "", 2)], "rule_id string, severity string, title string, server string, tool string, location string, n int")
    assert [r["value"] for r in sinks.json_lines(rows.select("rule_id", "n")).collect()] == ['{"rule_id":"R1","n":1}', '{"rule_id":"R2","n":2}']
    assert [r["row"] for r in sinks.markdown_rows(rows, ["rule_id", "title"]).collect()] == ['| R1 | a "b", c |', "| R2 | p\\|q |"]
    sinks.write_csv(rows, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", "\\").csv(str(tmp_path / "csv"))
    assert back.columns == ["rule_id", "severity", "title", "server", "tool", "location"] and {r["title"] for r in back.collect()} == {'a "b", c', "p|q"}
    made = spark.range(1).select(sinks.badge(F.lit("A"), F.lit(0.5)).alias("a"), sinks.badge(F.lit("F"), F.lit(9.0)).alias("f")).first()
    assert "#4c1" in made["a"] and "A 0.5" in made["a"] and "#e05d44" in made["f"] and "F 9.0" in made["f"]


def test_repositories(spark):
    urls = ["https://github.com/a/b.git", "https://github.com/a", "", None, "https://evil.test/github.com/a/b", "https://www.github.com/a/b/issues?x#y"]
    rows = spark.createDataFrame([(u,) for u in urls], "url string").coalesce(1)
    assert [r[0] for r in rows.select(text.repository("url")).collect()] == ["a/b", None, None, None, None, "a/b"]
