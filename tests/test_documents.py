"""Documents in parts, and alerts handed over once."""

import csv
import glob
import io
import json

import pytest
from pyspark.sql import functions as F

from palisade.sources import documents
from palisade.streaming import outbox

KIND = "timestamp string, event_id string, target string, detail string"
ROWS = [(f"2024-01-{i % 9 + 1:02d}", f"e{i:03d}", f"t{i}", ['plain', 'a "quote", and|bar', "two\nlines", None][i % 4]) for i in range(200)]


def joined(path):
    """The parts in the order of their names, as a plain concatenation."""
    folders = sorted(glob.glob(f"{path}/part=*"))
    files = [sorted(glob.glob(f"{f}/*.txt")) for f in folders]
    assert all(len(f) == 1 for f in files)
    return "".join(open(f[0], encoding="utf-8", newline="").read() for f in files), len(folders)


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(ROWS, KIND).repartition(5)


def test_audit_as_one_array_lines_and_csv(events, tmp_path):
    want = sorted(ROWS, key=lambda r: (r[0], r[1]))
    as_rows = lambda values: [tuple(v.get(c) for c in ("timestamp", "event_id", "target", "detail")) for v in values]
    documents.export_audit(events, f"{tmp_path}/json", "json")
    text, parts = joined(f"{tmp_path}/json")
    assert as_rows(json.loads(text)) == want and parts > 3
    documents.export_audit(events, f"{tmp_path}/jsonl", "jsonl")
    assert as_rows(map(json.loads, joined(f"{tmp_path}/jsonl")[0].splitlines())) == want
    documents.export_audit(events, f"{tmp_path}/csv", "csv")
    rows = list(csv.reader(io.StringIO(joined(f"{tmp_path}/csv")[0], newline="")))
    assert rows == [KIND.replace(" string", "").split(", "), *([c or "" for c in r] for r in want)]
    with pytest.raises(ValueError):
        documents.export_audit(events, f"{tmp_path}/x", "xml")


def test_reports_and_empty_documents(events, tmp_path):
    documents.write_markdown_table(events.select("event_id", "detail"), ["event_id"], f"{tmp_path}/md", "Events", parts=3)
    lines = joined(f"{tmp_path}/md")[0].splitlines()
    assert lines[:5] == ["# Events", "", "| event_id | detail |", "|---|---|", "| e000 | plain |"] and lines[5] == '| e001 | a "quote", and\\|bar |' and len(lines) == 204
    documents.write_json_array(events.limit(0), ["event_id"], f"{tmp_path}/none")
    assert json.loads(joined(f"{tmp_path}/none")[0]) == []
    documents.write_json_array(events.where("event_id = 'e007'"), ["event_id"], f"{tmp_path}/one")
    assert [r["event_id"] for r in json.loads(joined(f"{tmp_path}/one")[0])] == ["e007"]


def test_a_batch_run_twice_is_delivered_once(spark, tmp_path):
    root, sent = str(tmp_path), []
    batch = spark.createDataFrame([(1, "a"), (2, "b")], "id long, what string")

    def send(alerts, number):
        sent.append((number, sorted(r["id"] for r in alerts.collect())))

    assert outbox.deliver(batch, 7, root, send) and outbox.deliver(batch, 7, root, send)
    assert sent == [(7, [1, 2])]
    assert outbox.deliver(batch.limit(0), 8, root, send) and len(sent) == 1
    failures = []

    def broken(alerts, number):
        failures.append(number)
        if len(failures) != 2 or number != 9:
            raise OSError("receiver is away")

    assert outbox.deliver(batch, 9, root, broken)  # the second attempt goes through
    assert not outbox.deliver(batch.withColumn("id", F.col("id") + 10), 10, root, broken, attempts=2)
    assert not outbox.deliver(batch, 10, root, send)  # dead, not sent again by the stream
    got = {r["batch"]: (r["status"], r["attempts"], r["error"], r["alerts"]) for r in outbox.ledger(spark, root).collect()}
    assert got == {7: ("delivered", 1, None, 2), 8: ("delivered", 1, None, 0), 9: ("delivered", 2, None, 2), 10: ("dead", 2, "OSError: receiver is away", 2)}
    assert sorted((r["batch"], r["id"]) for r in outbox.dead_letters(spark, root).collect()) == [(10, 11), (10, 12)]
    assert outbox.redeliver(spark, root, send) == 1 and sent[-1] == (10, [11, 12]) and outbox.redeliver(spark, root, send) == 0
    with pytest.raises(LookupError):
        outbox.dead_letters(spark, root)


def test_a_stream_through_the_outbox(spark, tmp_path):
    source, root, sent = f"{tmp_path}/in", f"{tmp_path}/box", []
    spark.createDataFrame([(1,), (2,)], "id long").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("id long").parquet(source)
    for checkpoint in ("a", "b"):  # the second run starts anew and numbers its batches alike
        query = stream.writeStream.foreachBatch(lambda df, n: outbox.deliver(df, n, root, lambda x, k: sent.append((k, x.count())))).option("checkpointLocation", f"{tmp_path}/{checkpoint}")
        query.trigger(availableNow=True).start().awaitTermination(120)
    assert sent == [(0, 2)]
