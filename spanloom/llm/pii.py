"""Personal data: regular expressions propose, checksums confirm, context words adjust.

Base kinds (email, ip, card, phone) stay whatever their score. The kinds that the method
adds (iban with mod-97, ssn, secret) are kept where their score, moved by words within
``NEAR`` characters, reaches ``threshold``. Spans are in code points, end exclusive.

Null is the empty text; empty texts have no spans. Spans of different kinds may overlap, and
are ordered by start, then kind as listed in ``KINDS``. Repeated rows are judged each for
itself. Patterns are written so that they never rescan a run of characters; a text of
millions of digits takes time in proportion to its length.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .batches import prepare, slices, strings

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "secret")
NEAR = 48

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_TAIL = re.compile(r"[A-Za-z0-9._%+-]")
# a run of digits that can't start a match can't start one further on either
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])")
IBAN_RUN = re.compile(r"[A-Z0-9]++")
#: What a character counts in the check of an IBAN.
VALUE = {c: int(c, 36) for c in "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
#: Characters of an IBAN in countries that have it most.
IBAN_LENGTH = {"AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22,
               "IT": 27, "LT": 20, "LU": 20, "LV": 21, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "TR": 26}
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
SECRET = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,}+")
# places worth a look for the last three
TRIGGER = re.compile(r"[0-9]")

#: Words near a span and what they add to its score.
CONTEXT = {
    "email": {"mail": 0.1, "email": 0.1, "contact": 0.1},
    "ip": {"ip": 0.2, "host": 0.1, "server": 0.1, "version": -0.3},
    "card": {"card": 0.2, "visa": 0.2, "credit": 0.2, "order": -0.1},
    "phone": {"phone": 0.2, "tel": 0.2, "call": 0.1, "fax": 0.1},
    "iban": {"iban": 0.1, "bank": 0.1, "account": 0.1},
    "ssn": {"ssn": 0.4, "social": 0.3, "security": 0.2, "part": -0.2},
    "secret": {"token": 0.5, "secret": 0.5, "password": 0.5, "key": 0.4, "apikey": 0.5, "bearer": 0.5},
}
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.4, "secret": 0.2}
NEARBY_WORD = re.compile(r"[a-z]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def iban_ends(text: str, start: int) -> list[tuple[int, int]]:
    """(length, end) of the numbers from ``start`` that fulfil mod 97: they end after a run of capitals and digits; runs are
    parted by single spaces, and have 15 to 34 characters in all. The remainder is carried along, so an end costs nothing more."""
    ends, held, at, rest = [], 0, start, 0
    head = int("".join(str(VALUE[c]) for c in text[start:start + 4]))
    while m := IBAN_RUN.match(text, at):
        if held + m.end() - at > 34:
            break
        for c in text[max(at, start + 4):m.end()]:
            v = VALUE[c]
            rest = (rest * (10 if v < 10 else 100) + v) % 97
        held += m.end() - at
        after = text[m.end():m.end() + 1]
        if held >= 15 and not (after.isascii() and after.isalnum()) and (rest * 1_000_000 + head) % 97 == 1:
            ends.append((held, m.end()))
        if after != " ":
            break
        at = m.end() + 1
    return ends


def ibans(text: str):
    """Spans from each possible start: to the end that the country's length gives, else (and for other countries) to the last end that holds."""
    m = IBAN.search(text)
    while m:
        at = m.start() + 1
        ends = iban_ends(text, m.start())
        if ends:
            size = IBAN_LENGTH.get(text[m.start():m.start() + 2])
            at = next((end for held, end in ends if held == size), ends[-1][1])
            yield m.start(), at
        m = IBAN.search(text, at)


def emails(text: str):
    """Leftmost non-overlapping matches, found from each @ outwards."""
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and LOCAL_TAIL.match(text[start - 1]):
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
            at = text.find("@", last)
        else:
            last = max(last, at + 1)
            at = text.find("@", at + 1)


def proposed(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of confirmed spans, before scores."""
    out = [(a, 0, b) for a, b in emails(text)]
    if TRIGGER.search(text) is None:
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if 14 <= m.end() - m.start() <= 40 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    out += [(a, 4, b) for a, b in ibans(text)]
    if "-" in text:
        out += [(m.start(), 5, m.end()) for m in SSN.finditer(text)]
    for m in SECRET.finditer(text):
        if any(map(str.isdigit, m[0])) and any(map(str.isalpha, m[0])):
            out.append((m.start(), 6, m.end()))
    return out


def score(text: str, start: int, kind: str, end: int) -> float:
    near = NEARBY_WORD.findall(text[max(0, start - NEAR):start].lower()) + NEARBY_WORD.findall(text[end:end + NEAR // 2].lower())
    weights = CONTEXT[kind]
    moves = {w: weights[w] for w in near if w in weights}
    return min(1.0, max(0.0, PRIOR[kind] + sum(moves.values())))


def spans(text: str, threshold: float = 0.6) -> list[dict]:
    out = []
    for start, k, end in sorted(proposed(text)):
        s = score(text, start, KINDS[k], end)
        if k < len(BASE) or s >= threshold:
            out.append({"kind": KINDS[k], "start": start, "end": end, "score": round(s, 3)})
    return out


def redact(text: str, found: list[dict]) -> str:
    """Overlapping spans become one mark, named after the first of them."""
    out, at = [], 0
    for i, s in enumerate(found):
        if s["start"] >= at:
            end = s["end"]
            for t in found[i + 1:]:
                if t["start"] >= end:
                    break
                end = max(end, t["end"])
            out += [text[at:s["start"]], f"[{s['kind'].upper()}]"]
            at = end
    return "".join([*out, text[at:]])


SPAN = "struct<kind:string,start:int,end:int,score:double>"


def find(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", threshold: float = 0.6) -> DataFrame:
    """doc_id and spans array<struct<kind, start, end, score>>."""
    prepare(docs.sparkSession)
    narrow = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("__text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        for batch in slices(batches):
            found = [spans(t, threshold) for t in strings(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, spans array<{SPAN}>")


def redacted(docs: DataFrame, *, text: str = "text", threshold: float = 0.6) -> DataFrame:
    """The same columns with every span of ``text`` replaced by its kind in brackets; null stays null."""
    prepare(docs.sparkSession)
    at = docs.columns.index(text)
    schema = docs.schema

    def run(batches):
        for batch in slices(batches, at):
            new = [None if t is None else redact(t, spans(t, threshold)) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return docs.mapInArrow(run, schema)


def report(found: DataFrame) -> DataFrame:
    """Counts per base kind, and digests of base spans and of all spans."""
    def joined(c):
        return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
                        F.size("spans").cast("long").alias("n_spans"))
