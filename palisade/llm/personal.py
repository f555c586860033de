"""Personal data by anchor expansion: an automaton finds anchors, local parsers grow and check spans around them.

One Aho-Corasick pass over a text finds at-signs, plus signs, digits, schemes and identifier cues. Each anchor is handed
to the parser of its kind, which grows a span from it (to the left and right of an at-sign, to the right of the others),
never back into the last span of its kind, and checks it. A span that fails its check is dropped; what it covered is not
tried again. That gives the leftmost spans that do not overlap within their kind.

============  ==========================================================  =========================================
kind          form                                                        check
============  ==========================================================  =========================================
email         local part, at-sign, domain with a dot                      none
ip            four runs of digits between dots                            parts of at most 255
card          digits, each after at most one space or hyphen              13 to 19 digits, Luhn
phone         plus sign, digits with spaces, dots, hyphens, parentheses   9 to 15 digits
iban          after the cue "iban"                                        15 to 34 characters, remainder 1 modulo 97
account       digits after a cue ("account", "acct", "passport", "ssn")   6 to 18 digits
login         web or ftp address with a user before an at-sign            none
============  ==========================================================  =========================================

The first four are the base; the method adds the others. Spans of different kinds may overlap. Offsets count code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table
from .textops import chunks

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "account", "login")
ACCOUNT_CUES = ("account", "acct", "passport", "ssn")
SCHEMES = ("https://", "http://", "ftp://")

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
IBAN_FORM = r"\.?:? ?([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)"
ACCOUNT_FORM = r"(?: (?:number|no|id))?\.?[:#]? ?([A-Z]{0,2}[0-9]{2,}(?:[ -]?[0-9]{2,})*)"
LOGIN_FORM = r"[A-Za-z0-9._~%+:-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*"

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_RUN = re.compile(r"[0-9]+")
_ADDRESS = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN, _ACCOUNT, _LOGIN = (re.compile(p) for p in (IBAN_FORM, ACCOUNT_FORM, LOGIN_FORM))
_NO_DIGIT = re.compile(r"[^0-9]")
_WORD = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")


def spellings(cue: str) -> tuple[str, str, str]:
    return cue, cue.capitalize(), cue.upper()


def automaton() -> ahocorasick.Automaton:
    """Every anchor with its kind and length."""
    found = ahocorasick.Automaton()
    anchors = [("@", "at"), ("+", "plus"), *((d, "digit") for d in "0123456789"), *((s, "scheme") for s in SCHEMES)]
    anchors += [(s, "iban") for s in spellings("iban")]
    anchors += [(s, "account") for cue in ACCOUNT_CUES for s in spellings(cue)]
    for text, kind in anchors:
        found.add_word(text, (kind, len(text)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def iban_holds(code: str) -> bool:
    if not 15 <= len(code) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def spans_of(text: str, anchors: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end) of one text, by kind as listed and then by start."""
    found: dict[str, list[tuple[str, int, int]]] = {kind: [] for kind in KINDS}
    past = dict.fromkeys(KINDS, 0)  # where the last span of a kind ended, or what need not be tried again

    def cued(kind: str, form: re.Pattern, first: int, after: int, holds) -> None:
        if first < past[kind] or (first and text[first - 1] in _WORD):
            return
        m = form.match(text, after)
        if m:
            past[kind] = m.end()
            if holds(m[1]):
                found[kind].append((kind, m.start(1), m.end()))

    for last, (anchor, length) in anchors.iter(text):
        at = last - length + 1
        if anchor == "digit":
            if at >= past["ip"]:
                m = _ADDRESS.match(text, at)
                past["ip"] = (m or _RUN.match(text, at)).end()
                if m and all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m.groups()):
                    found["ip"].append(("ip", at, m.end()))
            if at >= past["card"]:
                m = _CHAIN.match(text, at)
                past["card"] = m.end() if m else at + 1
                if m and m.end() - at >= 13:
                    digits = _NO_DIGIT.sub("", m[0])
                    if 13 <= len(digits) <= 19 and luhn(digits):
                        found["card"].append(("card", at, m.end()))
        elif anchor == "at":
            first = at
            while first > past["email"] and text[first - 1] in LOCAL:
                first -= 1
            m = first < at and _DOMAIN.match(text, at + 1)
            if m:
                past["email"] = m.end()
                found["email"].append(("email", first, m.end()))
        elif anchor == "plus":
            m = _PHONE.match(text, at)
            if m and 9 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
                found["phone"].append(("phone", at, m.end()))
        elif anchor == "scheme":
            m = at >= past["login"] and _LOGIN.match(text, last + 1)
            if m:
                past["login"] = m.end()
                found["login"].append(("login", at, m.end()))
        elif anchor == "iban":
            cued("iban", _IBAN, at, last + 1, lambda code: iban_holds(code.replace(" ", "")))
        else:
            cued("account", _ACCOUNT, at, last + 1, lambda code: 6 <= len(_NO_DIGIT.sub("", code)) <= 18)
    return [span for kind in KINDS for span in found[kind]]


def redacted_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each span replaced by its kind in brackets; spans that overlap become one, named after the first."""
    parts, past = [], 0
    for start, end, kind in sorted((s, -e, k) for k, s, e in spans):
        if start >= past:
            parts += [text[past:start], f"[{kind.upper()}]"]
        past = max(past, -end)
    return "".join([*parts, text[past:]])


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_personal(docs: DataFrame, columns: list[str] | None = None, redact: bool = False) -> DataFrame:
    """``columns`` (``doc_id`` by default) of every row with ``spans``, an array of (kind, start, end).

    With ``redact``, a column ``redacted`` holds the text without them. Null texts count as empty and give no spans;
    rows that repeat, and rows without an id, get a result each; an empty table gives no rows. Columns that are not
    asked for, and those with the name of a result, are left out.
    """
    columns = [c for c in columns or ["doc_id"] if c not in ("spans", "redacted")]
    held = docs.select(F.col("text").alias("_text"), *columns)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields[1:])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in batches:
            for run in chunks(batch.column(0)):
                spans, clean = [], []
                for i in range(len(run)):
                    text = run.data[run.offsets[i] : run.offsets[i + 1]].tobytes().decode("utf-8", "replace")
                    found = spans_of(text, anchors)
                    spans.append([dict(zip(("kind", "start", "end"), s)) for s in found])
                    if redact:
                        clean.append(redacted_text(text, found))
                part = batch.slice(run.first, len(run))
                arrays = [*part.columns[1:], pa.array(spans, SPANS), *([pa.array(clean, pa.string())] if redact else [])]
                yield pa.RecordBatch.from_arrays(arrays, [*columns, "spans", *(["redacted"] if redact else [])])

    schema = f"{kept + ', ' if kept else ''}spans array<struct<kind: string, start: bigint, end: bigint>>"
    return held.mapInArrow(search, schema + (", redacted string" if redact else ""))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op13_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of documents: counts and hash of the base spans, and all spans.

    See ``find_personal`` for nulls, empty texts and repeated rows; the counts are those of the base spans.
    """
    found = find_personal(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *(count(kind) for kind in BASE),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def _oracle() -> str:
    cues = "|".join(s for cue in ACCOUNT_CUES for s in spellings(cue))
    forms = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(?:\.[0-9]+){3}",
        "card": r"[0-9](?:[ -]?[0-9])+",
        "phone": r"\+[0-9][ ().0-9-]+[0-9]",
        "iban": rf"\b(?:{'|'.join(spellings('iban'))}){IBAN_FORM}",
        "account": rf"\b(?:{cues}){ACCOUNT_FORM}",
        "login": rf"(?:{'|'.join(SCHEMES)}){LOGIN_FORM}",
    }
    hits = " UNION ALL ".join(
        f"""SELECT r, {n} AS n, '{kind}' AS kind, unnest(string_split_regex(text, '{form}')) AS gap,
            unnest(list_concat(regexp_extract_all(text, '{form}'), [NULL])) AS hit,
            unnest(list_concat(regexp_extract_all(text, '{form}', {int(kind in ("iban", "account"))}), [NULL])) AS span,
            generate_subscripts(list_concat(regexp_extract_all(text, '{form}'), [NULL]), 1) AS i FROM d"""
        for n, (kind, form) in enumerate(forms.items())
    )
    return rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
hits AS ({hits}),
placed AS (
  SELECT r, n, kind, span, regexp_replace(span, '[^0-9]', '', 'g') AS digits,
    sum(length(gap) + coalesce(length(hit), 0)) OVER (PARTITION BY r, n ORDER BY i) AS stop
  FROM hits
),
checked AS (
  SELECT r, n, kind, (stop - length(span))::BIGINT AS start, stop::BIGINT AS stop FROM placed
  WHERE span IS NOT NULL AND CASE kind
    WHEN 'ip' THEN len(list_filter(string_split(span, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(right(x, 3) AS INTEGER), 0) > 255)) = 0
    WHEN 'card' THEN length(digits) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1),
      lambda j: CASE WHEN j % 2 = 1 THEN substr(reverse(digits), j, 1)::INTEGER
           ELSE (2 * substr(reverse(digits), j, 1)::INTEGER) // 10 + (2 * substr(reverse(digits), j, 1)::INTEGER) % 10 END)) % 10 = 0
    WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15
    WHEN 'account' THEN length(digits) BETWEEN 6 AND 18
    WHEN 'iban' THEN length(replace(span, ' ', '')) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, list_transform(
      string_split(substr(replace(span, ' ', ''), 5) || left(replace(span, ' ', ''), 4), ''),
      lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)),
      lambda a, b: CASE WHEN b > 9 THEN (a * 100 + b) % 97 ELSE (a * 10 + b) % 97 END) = 1
    ELSE true END
),
said AS (
  SELECT r, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip,
    count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY n, start) FILTER (n < 4) AS base,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY n, start) AS spans
  FROM checked GROUP BY r
)
SELECT doc_id, coalesce(n_email, 0)::BIGINT AS n_email, coalesce(n_ip, 0)::BIGINT AS n_ip, coalesce(n_card, 0)::BIGINT AS n_card,
  coalesce(n_phone, 0)::BIGINT AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN said USING (r)"""


ORACLE = _oracle()
