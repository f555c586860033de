"""The type guards of reports against plain Python."""

import json
import random

from palisade.sources import readers

VALUES = ["text", 7, 2.5, True, None, {"k": 1}, [1], "High", "low", "odd"]


def plain(source, text, errors):
    """Rows of one report; appends its errors."""
    try:
        value = json.loads(text)
    except (TypeError, ValueError):
        value = None
    if not isinstance(value, dict):
        errors.append((source, "", "no report"))
        return None, [], []

    def guard(node, name, kind, place):
        if name not in node:
            return {"text": "", "flag": False, "object": {}}[kind]
        x = node[name]
        fits = {"text": isinstance(x, (str, int, float)) and not isinstance(x, bool), "flag": isinstance(x, bool), "object": isinstance(x, dict)}[kind]
        if not fits:
            errors.append((source, place + name, f"no {kind}: {json.dumps(x, separators=(',', ':'))}"))
            return {"text": "", "flag": False, "object": {}}[kind]
        return str(x) if kind == "text" else x

    report = tuple(guard(value, n, k, "") for n, k in readers.REPORT_FIELDS.items())
    parts = {}
    for name, fields in (("tools", readers.TOOL_FIELDS), ("findings", readers.FINDING_FIELDS)):
        parts[name] = []
        if name in value and not isinstance(value[name], list):
            errors.append((source, name, f"no list: {json.dumps(value[name], separators=(',', ':'))}"))
            continue
        for i, node in enumerate(value.get(name, [])):
            if not isinstance(node, dict):
                errors.append((source, f"{name}[{i}]", f"no object: {json.dumps(node, separators=(',', ':'))}"))
                continue
            row = {n: guard(node, n, k, f"{name}[{i}].") for n, k in fields.items()}
            if name == "findings":
                if row["severity"].lower() not in readers.SEVERITIES:
                    errors.append((source, f"findings[{i}].severity", f"no severity: {row['severity']}"))
                    continue
                row["severity"] = row["severity"].lower()
            parts[name].append((i, *row.values()))
    return report, parts["tools"], parts["findings"]


def test_guards_equal_plain_python(spark):
    rnd = random.Random(9)
    pick = lambda fields: {f: rnd.choice(VALUES) for f in fields if rnd.random() < 0.6}
    rows = []
    for i in range(150):
        report = pick(readers.REPORT_FIELDS)
        for name, fields in (("tools", readers.TOOL_FIELDS), ("findings", readers.FINDING_FIELDS)):
            if rnd.random() < 0.8:
                report[name] = [pick(fields) if rnd.random() < 0.8 else rnd.choice(VALUES) for _ in range(rnd.randint(0, 4))] if rnd.random() < 0.9 else rnd.choice(VALUES)
        rows.append((i, json.dumps(report)))
    rows += [(200, None), (201, "{"), (202, "[]"), (203, "{}"), (204, '"x"')]
    errors, want = [], {}
    for i, text in rows:
        want[i] = plain(i, text, errors)
    reports, tools, findings, refused = readers.report_rows(spark.createDataFrame(rows, "source long, text string"))
    assert sorted(tuple(r) for r in refused.collect()) == sorted(errors) and len(errors) > 200
    assert {r["source"]: tuple(r)[1:] for r in reports.collect()} == {i: w[0] for i, w in want.items() if w[0]}
    for frame, k in ((tools, 1), (findings, 2)):
        got = sorted((r["source"], *(json.loads(v) if c in ("input_schema", "output_schema", "detail") else v for c, v in r.asDict().items() if c != "source")) for r in frame.collect())
        assert str(got) == str(sorted(((i, *row) for i, w in want.items() for row in w[k]), key=lambda r: r[:2]))


def test_findings_by_target_are_sums(spark):
    """Scans that repeat and nulls count as in a join; tasks grow with the rows, and no scan is told apart after it."""
    from palisade.operators import stats

    findings = spark.createDataFrame([(1, "R1"), (1, "R1"), (1, None), (2, "R1"), (None, "R1"), (9, "R1")], "scan_id long, rule_id string")
    scans = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (1, "b"), (None, "a"), (3, "c")], "scan_id long, target string")
    found = stats.findings_by_target(findings, scans, per_task=1)
    want = findings.join(scans, "scan_id").groupBy("target", "rule_id").agg({"*": "count"}).collect()
    assert {(r["target"], r["rule_id"]): r["n"] for r in found.collect()} == {(r[0], r[1]): r[2] for r in want}
    assert {(r["target"], r["rule_id"]): r["scans"] for r in found.collect()} == {("a", "R1"): 2, ("a", None): 1, ("b", "R1"): 1, ("b", None): 1}
    assert "distinct" not in found._jdf.queryExecution().optimizedPlan().toString()
