"""Signed snapshot envelopes: canonical payload, its digest, and an Ed25519 signature; and their verification, row by row in tasks."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import signing
from ..functions.rows import spread

SCHEMA = "https://palisade.example/schemas/signed-snapshot-v1.json"


def key_id(key: bytes) -> str:
    return hashlib.sha256(key).hexdigest()[:24]


def enveloped(text: str | None, seed: bytes, key: bytes, signed_at: str) -> str | None:
    """The envelope of a payload in JSON text; None if it is no JSON object."""
    try:
        payload = json.loads(text or "")
        message = signing.canonical_bytes(payload)
    except ValueError:
        return None
    if not isinstance(payload, dict):
        return None
    return signing.canonical_bytes(
        {
            "$schema": SCHEMA,
            "payload": payload,
            "provenance": {
                "report_schema_version": str(payload.get("report_schema_version", "unknown")),
                "target": str(payload.get("target", "")),
                "signed_at": signed_at,
                "payload_sha256": hashlib.sha256(message).hexdigest(),
            },
            "signature": {"algorithm": "Ed25519", "key_id": key_id(key), "public_key": base64.b64encode(key).decode(), "value": base64.b64encode(signing.sign(seed, message)).decode()},
        }
    ).decode()


def problem_of(text: str | None, expected: bytes | None) -> str | None:
    """Why an envelope is not to be trusted; None if it is."""
    try:
        envelope = json.loads(text or "")
    except ValueError:
        return "no JSON"
    if not isinstance(envelope, dict) or envelope.get("$schema") != SCHEMA:
        return "unknown schema"
    payload, provenance, signature = (envelope.get(x) for x in ("payload", "provenance", "signature"))
    if not all(isinstance(x, dict) for x in (payload, provenance, signature)) or signature.get("algorithm") != "Ed25519":
        return "malformed"
    try:
        key, value = (base64.b64decode(signature[x], validate=True) for x in ("public_key", "value"))
    except (KeyError, TypeError, ValueError, binascii.Error):
        return "bad encoding"
    if signature.get("key_id") != key_id(key):
        return "key id of another key"
    if expected is not None and key != expected:
        return "signed by another key"
    try:
        message = signing.canonical_bytes(payload)
    except ValueError:
        return "payload is not canonical"
    if provenance.get("payload_sha256") != hashlib.sha256(message).hexdigest():
        return "digest differs"
    return None if signing.verify(key, message, value) else "signature is wrong"


def sign_payloads(rows: DataFrame, seed: bytes, signed_at: str, column: str = "payload") -> DataFrame:
    """Adds ``envelope`` to rows with a payload in JSON text; null where that is no JSON object. ``seed`` is the private key, 32 bytes."""
    key = signing.public_key(seed)

    @F.pandas_udf("string")
    def signed(text: pd.Series) -> pd.Series:
        return text.map(lambda x: enveloped(x, seed, key, signed_at))

    return spread(rows).withColumn("envelope", signed(column))


def verify_envelopes(rows: DataFrame, expected: bytes | None = None, column: str = "envelope") -> DataFrame:
    """Adds ``problem``, null for envelopes that hold: whose schema, key identity, digest and signature are right, by the key ``expected`` if given."""

    @F.pandas_udf("string")
    def checked(text: pd.Series) -> pd.Series:
        return text.map(lambda x: problem_of(x, expected))

    return spread(rows).withColumn("problem", checked(column))
