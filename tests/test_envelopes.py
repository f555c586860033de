"""Signed envelopes: known signatures, agreement with the JVM's keys, and tampering."""

import base64
import json

from palisade.functions import signing
from palisade.sources import envelopes


def test_known_signatures():
    """Test vectors of RFC 8032, section 7.1."""
    seed = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
    key = "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"
    value = "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"
    assert signing.public_key(seed).hex() == key and signing.sign(seed, b"").hex() == value
    assert signing.verify(bytes.fromhex(key), b"", bytes.fromhex(value)) and not signing.verify(bytes.fromhex(key), b"x", bytes.fromhex(value))
    assert not signing.verify(bytes.fromhex(key), b"", bytes(64)) and not signing.verify(b"\xff" * 32, b"", bytes.fromhex(value)) and not signing.verify(b"", b"", b"")


def test_signatures_of_the_jvm_are_verified(spark):
    java = spark._jvm.java.security
    pair = java.KeyPairGenerator.getInstance("Ed25519").generateKeyPair()
    factory, named = java.KeyFactory.getInstance("Ed25519"), spark._jvm.java.lang.Class.forName
    encoded = lambda own, kind: bytes(factory.getKeySpec(own, named(f"java.security.spec.{kind}EncodedKeySpec")).getEncoded())[-32:]
    key = encoded(pair.getPublic(), "X509")
    signer = java.Signature.getInstance("Ed25519")
    signer.initSign(pair.getPrivate())
    message = signing.canonical_bytes({"b": [1, {"é": None}], "a": "x"})
    assert message == '{"a":"x","b":[1,{"é":null}]}'.encode()
    signer.update(bytearray(message))
    value = bytes(signer.sign())
    assert signing.verify(key, message, value) and not signing.verify(key, message + b" ", value)
    # And the JVM takes what tasks sign: the same seed gives the same public key and signature.
    seed = encoded(pair.getPrivate(), "PKCS8")
    assert signing.public_key(seed) == key and signing.sign(seed, message) == value


def test_signed_and_tampered_rows(spark):
    seed, other = bytes(range(32)), bytes(32)
    rows = [(1, '{"target":"t","b":{"y":1,"x":[2.5,null]}}'), (2, "[1]"), (3, None), (4, '{"n":NaN}'), (5, '{"target":"ü"}')]
    signed = envelopes.sign_payloads(spark.createDataFrame(rows, "id long, payload string"), seed, "2024-01-01")
    text = {r["id"]: r["envelope"] for r in signed.collect()}
    assert text[2] is None and text[3] is None and text[4] is None

    def changed(edit):
        value = json.loads(text[1])
        edit(value)
        return json.dumps(value)

    cases = {
        text[1]: None,
        json.dumps(json.loads(text[5]), indent=2): None,
        changed(lambda v: v["payload"]["b"].update(y=2)): "digest differs",
        changed(lambda v: v["signature"].update(value=base64.b64encode(bytes(64)).decode())): "signature is wrong",
        changed(lambda v: v["signature"].update(value="%")): "bad encoding",
        changed(lambda v: v["signature"].update(key_id="0")): "key id of another key",
        changed(lambda v: v["signature"].update(algorithm="none")): "malformed",
        changed(lambda v: v.update(payload=[1])): "malformed",
        changed(lambda v: v.update({"$schema": "x"})): "unknown schema",
        "{": "no JSON",
        envelopes.enveloped('{"target":"t"}', other, signing.public_key(other), "2024"): "signed by another key",
    }
    frame = spark.createDataFrame([(x,) for x in cases], "envelope string")
    assert {r["envelope"]: r["problem"] for r in envelopes.verify_envelopes(frame, signing.public_key(seed)).collect()} == cases


def test_rows_of_one_file_are_signed_and_verified_by_many_tasks(spark, tmp_path):
    """A table of one file was one task."""
    from pyspark.sql import functions as F

    spark.range(400).selectExpr("concat('{\"target\":\"', id, '\"}') AS payload").coalesce(1).write.parquet(str(tmp_path / "p"))
    rows = envelopes.sign_payloads(spark.read.parquet(str(tmp_path / "p")), bytes(32), "now")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert rows.withColumn("p", F.spark_partition_id()).select("p").distinct().count() == n
    checked = envelopes.verify_envelopes(rows.coalesce(1)).withColumn("p", F.spark_partition_id())
    assert checked.select("p").distinct().count() == n and checked.where("problem is not null").count() == 0


def test_tables_of_multiples_equal_doubling():
    point = signing._unpacked(signing.public_key(b"k" * 32))
    for n in (0, 1, 255, 256, signing.ORDER - 1, 2**255 + 12345):
        want = signing._packed(signing._times(n, point))
        assert signing._packed(signing._times_table(n, signing._table(point, 4), 4)) == want
        assert signing._packed(signing._times_base(n)) == signing._packed(signing._times(n, signing.BASE))


def test_keys_that_come_again_are_verified_alike():
    for seed in (b"a" * 32, b"b" * 32):
        key, value = signing.public_key(seed), signing.sign(seed, b"m")
        for _ in range(4):
            assert signing.verify(key, b"m", value) and not signing.verify(key, b"n", value)
            assert not signing.verify(key, b"m", value[:32] + bytes([value[32] ^ 1]) + value[33:]) and not signing.verify(key, b"m", b"\xff" * 32 + value[32:])
