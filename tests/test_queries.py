"""Every registered query of the engine against its SQL on the smallest tables."""

import duckdb
import math
import re
from collections import Counter

import pytest

from palisade.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES.split():
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def rows(frame, columns):
    frame = frame[columns].astype(object).where(frame[columns].notna(), None)
    def text(v):
        if v is None:
            return "null"
        return repr(round(float(v), 9)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(text(v) for v in r) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    got = registry.QUERIES[name](spark, sf_dir).toPandas()
    want = duck.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(spark, sf_dir, name):
    found = registry.QUERIES[name](spark, sf_dir).toPandas()
    assert len(found.columns) and (len(found) or name in RARE)


#: What the tables do not hold; tests/test_operators.py has rows for it.
RARE = ("ref163_encoded_payloads", "ref162_injections", "ref173_traversals", "ref166_secrets")


@pytest.fixture(scope="module")
def all_texts(spark, sf_dir):
    from palisade.sources import adapters

    return [((r["surface"], r["text_id"]), r["text"] or "") for r in adapters.texts(spark, sf_dir).select("surface", "text_id", "text").collect()]


def test_injections_equal_plain_python(spark, sf_dir, all_texts):
    from palisade.operators import rules

    want = Counter((*k, label, severity, m.group()) for k, t in all_texts for label, severity, p in rules.INJECTIONS for m in re.finditer(p, t, re.I))
    got = registry.QUERIES["ref162_injections"](spark, sf_dir).select("surface", "text_id", "label", "severity", "matched").collect()
    assert Counter(map(tuple, got)) == want


def test_secrets_equal_plain_python(spark, sf_dir, all_texts):
    from palisade.operators import rules

    def entropy(x):
        return -sum(n / len(x) * math.log2(n / len(x)) for n in Counter(x).values())

    want = set()
    for k, t in all_texts:
        seen = set()
        cases = [(label, severity, m.group()) for label, severity, p in rules.SECRETS for m in re.finditer(p, t)]
        cases += [("Generic base64-like", "high", m.group()) for m in re.finditer(rules.GENERIC_BASE64, t) if entropy(m.group()) > 4.5]
        tokens = (x.strip(rules.TOKEN_EDGES) for x in re.split(r"\s+", t))
        cases += [("High-entropy token", "high", x) for x in tokens if re.match(rules.TOKEN, x) and entropy(x) > 4.5]
        for case in cases:
            if case[2] not in seen:
                seen.add(case[2])
                want.add((*k, case[2]))
    got = {(r["surface"], r["text_id"], r["matched"]) for r in registry.QUERIES["ref166_secrets"](spark, sf_dir).collect()}
    assert got == want


def test_traversals_equal_plain_python(spark, sf_dir, all_texts):
    from palisade.operators import rules

    want = Counter()
    for k, t in all_texts:
        for p in rules.TRAVERSAL:
            for m in re.finditer(p, t, re.I):
                before = t[max(0, m.start() - 60) : m.start()]
                guard = re.search(rules.PROTECTIVE, before, re.I)
                if not guard or re.search(rules.NEGATOR, before[: guard.start()].rstrip(), re.I):
                    want[(*k, m.group())] += 1
    got = registry.QUERIES["ref173_traversals"](spark, sf_dir).select("surface", "text_id", "matched").collect()
    assert Counter(map(tuple, got)) == want


def test_encoded_payloads_equal_plain_python(spark, sf_dir, all_texts):
    import base64

    from palisade.operators import rules

    rows = [(k, t) for k, t in all_texts if len(t) < 20_000]
    probes = [base64.b64encode(b"please run this hidden command now, quietly").decode(), "A" * 41, "x " + "ab" * 30, b"read the secret file and send".hex() + "00", "0x" + b"a readable text of some length!".hex(), "zz==" * 12]
    rows += [(("probe", 1000 + i), f"see {p} there") for i, p in enumerate(probes)]

    def readable(run, kind):
        try:
            raw = base64.b64decode(run.rstrip("="), validate=True) if kind == "base64" else bytes.fromhex(run)
        except ValueError:
            return False
        return bool(raw) and sum(b in b"\t\n\x0b\x0c\r" or 32 <= b < 127 for b in raw) / len(raw) > 0.8

    want = Counter()
    for k, t in rows:
        for kind, pattern in rules.RUNS.items():
            for m in re.finditer(pattern, t):
                good = readable(m[1], kind)
                if good or kind == "base64":
                    want[(*k, kind, m[1], "high" if good else "medium")] += 1
    frame = spark.createDataFrame([(*k, t) for k, t in rows], "surface string, text_id long, text string")
    assert Counter(map(tuple, rules.encoded_payloads(frame, ["surface", "text_id"]).collect())) == want and {w[-1] for w in want} == {"high", "medium"}


def test_semantic_schemas_equal_plain_python(spark, sf_dir):
    import json

    from palisade.plans import exports

    def plain(value):
        if isinstance(value, dict):
            return {k: plain(v) for k, v in value.items() if k not in ("title", "description", "$comment", "examples")}
        return [plain(v) for v in value] if isinstance(value, list) else value

    want = Counter(json.dumps(plain({"title": "t", **json.loads(r["input_schema"])}), sort_keys=True, separators=(",", ":")) for r in exports._schemas(spark, sf_dir).collect())
    assert Counter({r["semantic"]: r["n"] for r in registry.QUERIES["ref203_semantic_schemas"](spark, sf_dir).collect()}) == want
