"""Personal data by anchor expansion against plain regular expressions, SQL, and on odd inputs."""

import random
import re
import time

import duckdb
import pyarrow as pa

from palisade.llm import personal
from palisade.llm.queries import ORACLES, QUERIES
from palisade.llm.tables import table

PARTS = [
    "a", "b.c", "@", "@x", "a.b@c-d.org", ".", " ", "-", "+", "1", "12", "255", "256", "4111 1111 1111 1111", "4111-1111-1111-1112", "iban DE89 3704 0044 0532 0130 00",
    "Account no. 123456", "acct: AB12 3456-78", "https://u:p@h.co", "+1 (660) 555-6869", "..", "é", "ü1", "_account 1234567", "ftp://x@y", "0001.2.3.4", "(", ")", "\n",
    "IBAN: GB82WEST12345698765432", "passport", "SSN 123-45-6789", "127.0.0.1",
]


def texts():
    rnd = random.Random(4)
    return ["".join(rnd.choices(PARTS, k=rnd.randint(0, 12))) for _ in range(4000)] + ["", "1" * 3000, "a" * 3000 + "@", "@" * 3000, "+1" + "(" * 3000, "1." * 3000]


def plain_base(text):
    forms = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    found = []
    for kind, form in forms.items():
        for m in re.finditer(form, text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 13 <= len(digits) <= 19 and sum(v - 9 * (v > 9) for v in doubled) % 10 == 0,
                "phone": 9 <= len(digits) <= 15,
            }
            if good[kind]:
                found.append((kind, m.start(), m.end()))
    return found


def test_base_spans_are_those_of_the_forms():
    anchors = personal.automaton()
    for text in texts():
        assert [s for s in personal.spans_of(text, anchors) if s[0] in personal.BASE] == plain_base(text)


def test_all_spans_are_those_of_the_sql():
    documents = pa.table({"doc_id": list(range(len(texts()))), "text": texts()})
    con = duckdb.connect()
    con.register("documents", documents)
    found = con.sql(f"SELECT doc_id, spans FROM ({ORACLES['op13_personal']}) ORDER BY doc_id").fetchall()
    anchors = personal.automaton()
    assert found == [(i, ",".join("%s:%d:%d" % s for s in personal.spans_of(t, anchors))) for i, t in enumerate(texts())]


def test_cues_and_checks():
    anchors = personal.automaton()

    def told(text):
        return [(k, text[s:e]) for k, s, e in personal.spans_of(text, anchors)]

    assert told("Iban: DE89 3704 0044 0532 0130 00, account number: 1234-5678.") == [("iban", "DE89 3704 0044 0532 0130 00"), ("account", "1234-5678")]
    assert told("IBAN DE89 3704 0044 0532 0130 01") == []
    assert told("see http://me:secret@host.org/x and http://host.org/x") == [("email", "secret@host.org"), ("login", "http://me:secret@host.org")]
    assert told("my accounts 12 and subaccount 1234567, account 12345") == []
    assert told("from 10.0.0.1.5 and 999.1.1.1") == [("ip", "10.0.0.1")]


def test_long_texts_take_linear_time():
    anchors = personal.automaton()
    began = time.perf_counter()
    for text in ("1" * 300_000, "1." * 150_000, "1 " * 150_000, "a" * 300_000 + "@", "@" * 300_000, "+1" + "(" * 300_000, "account " * 40_000):
        personal.spans_of(text, anchors)
    assert time.perf_counter() - began < 20


def test_query_equals_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    found = con.sql(ORACLES["op13_personal"])
    query = QUERIES["op13_personal"](spark, sf_dir)
    assert sorted(map(repr, found.fetchall())) == sorted(repr(tuple(r[c] for c in found.columns)) for r in query.collect())
    assert query.columns[:7] == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    assert table(spark, sf_dir, "documents").count() == query.count()


def test_odd_rows_and_redaction(spark):
    rows = [(None, "mail a@b.co now", 1), (1, None, 2), (1, "", 3), (2, "no data", 4), (2, "no data", 4), (3, "x " * 50_000 + "+1 (660) 555-6869", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans long").repartition(2)
    found = personal.find_personal(docs, ["doc_id", "spans"], redact=True)
    assert found.columns == ["doc_id", "spans", "redacted"]
    got = sorted((str(r["doc_id"]), r["redacted"][-22:], len(r["spans"])) for r in found.collect())
    assert got == [("1", "", 0), ("1", "", 0), ("2", "no data", 0), ("2", "no data", 0), ("3", ("x " * 9 + "[PHONE]")[-22:], 1), ("None", "mail [EMAIL] now", 1)]
    assert personal.find_personal(docs.limit(0)).collect() == []
