"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score.

1. Patterns propose. The base kinds are email, ip, card and phone, leftmost and non-overlapping per kind; iban, local_phone
   and ssn are added. Every pattern is laid out so that a text is read a bounded number of times, also one long run of
   characters that a pattern nearly matches: an address is found from its `@`, numbers from the start of their digits.
2. Validators confirm: parts of at most 255 for ip, 13 to 19 digits passing Luhn for card, 9 to 15 digits for phone, the
   country's length and mod-97 for iban, ranges in use for ssn. A proposal that fails is dropped and not tried again shorter.
3. Context adjusts: words of a kind's list within CONTEXT code points to either side raise a span's score, words that speak
   of other numbers (orders, versions, serial numbers) lower it.

Base spans stay whatever their score; added ones need a score of `least`, which ssn and local_phone reach with context only, and
local_phone gives way to base spans it overlaps. All of it is a pass over the rows without a shuffle, and a text is handled
alone in its task; memory is that of one batch of texts.

Offsets are code points, ends exclusive. Null and empty texts have no spans. Repeated rows and null ids are rows of their
own. Texts of any length are read whole, in time proportional to their length. An empty table gives no rows. Other columns
are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from rubrica.llm.common import pick

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "local_phone", "ssn")
CONTEXT = 48

# --- fixed values: characters and patterns of the base kinds ---
LOCAL_PART = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# --- fixed values: lengths of account numbers by country ---
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24,
    "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19,
    "SK": 24, "SM": 27, "TR": 26,
}
IBAN_HEAD = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
IBAN_TAIL = {n: re.compile(rf"(?: ?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for n in sorted(set(IBAN_LENGTHS.values()))}
SSN = re.compile(r"(?<![\w-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![\w-])")
LOCAL_PHONE = re.compile(r"(?<![\w+.-])\(?[0-9]{2,5}\)?[ ./-][0-9]{3,4}[ .-]?[0-9]{3,5}(?![\w-])")

# --- own choices: scores and words ---
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "local_phone": 0.3, "ssn": 0.3}
RAISE, LOWER = 0.3, 0.3
_CALLS = "phone telephone tel mobile cell call fax telefon handy rufnummer téléphone portable appelez teléfono móvil llame"
WORDS = {
    kind: frozenset(words.split())
    for kind, words in {
        "email": "email mail e-mail contact write correo courriel kontakt schreiben",
        "ip": "ip address host server client login adresse dirección",
        "card": "card credit debit visa mastercard amex karte kreditkarte carte tarjeta",
        "phone": _CALLS,
        "iban": "iban account bank transfer konto überweisung compte virement cuenta",
        "local_phone": _CALLS,
        "ssn": "ssn social security",
    }.items()
}
OTHERS = frozenset("version order invoice serial isbn issn sku release build chapter section bestellnummer rechnung".split())
WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")

COLUMNS = "spans array<struct<kind:string,start:int,end:int,score:double>>"


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    """Whether digits pass the check: from the right, every second one is doubled, less 9 above 9; the sum ends in 0."""
    total = sum(map(int, digits[-1::-2])) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def mod97(account: str) -> bool:
    """Whether an account number without spaces leaves 1: its head moved to the end, letters as 10 to 35."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """An address begins with the run of local characters before its @, as far as no address before holds them."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(LOCAL_PART))
        free = at + 1  # an @ belongs to no local part
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        at = text.find("@", free)


def ips(text: str) -> Iterator[tuple[int, int]]:
    # digits that an address leaves over cannot begin another, so one begins where a run of digits does
    for m in IP.finditer(text):
        if all(len(p := part.lstrip("0")) < 4 and int(p or 0) <= 255 for part in m[0].split(".")):
            yield m.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        if m.end() - m.start() < 2 * 19 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                yield m.span()


def ibans(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    for m in IBAN_HEAD.finditer(text):
        size = IBAN_LENGTHS.get(m[0][:2])
        tail = IBAN_TAIL[size].match(text, m.end()) if size and m.start() >= end else None
        if tail and mod97((m[0] + tail[0]).replace(" ", "")):
            end = tail.end()
            yield m.start(), end


def near(text: str, start: int, end: int) -> set[str]:
    """Lower-case words within CONTEXT code points; one that the window cuts is not among them."""
    low, high = max(0, start - CONTEXT), min(len(text), end + CONTEXT)
    words = set()
    for begin, stop in ((low, start), (end, high)):
        for m in WORD.finditer(text, begin, stop):
            cut = (m.start() == low and low and text[low - 1].isalnum()) or (m.end() == high and high < len(text) and text[high].isalnum())
            if not cut:
                words.add(m[0].lower())
    return words


def score(kind: str, text: str, start: int, end: int) -> float:
    words = near(text, start, end)
    value = SCORES[kind] + RAISE * bool(words & WORDS[kind]) - LOWER * bool(words & OTHERS)
    return round(min(max(value, 0.0), 1.0), 2)


def detect(text: str | None, least: float = 0.5) -> list[Span]:
    """Spans of a text by kind, BASE then ADDED, and start."""
    if not text:
        return []
    base = [(k, s, e) for k, find in (("email", emails), ("ip", ips), ("card", cards), ("phone", phones)) for s, e in find(text)]
    spans = [Span(k, s, e, score(k, text, s, e)) for k, s, e in base]
    taken = sorted((s, e) for _, s, e in base)
    more = [("iban", s, e) for s, e in ibans(text)]
    at = 0
    for m in LOCAL_PHONE.finditer(text):
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        if 7 <= len(_digits(m[0])) <= 12 and not (at < len(taken) and taken[at][0] < m.end()):
            more.append(("local_phone", *m.span()))
    more += [("ssn", *m.span()) for m in SSN.finditer(text)]
    return spans + [x for k, s, e in more if (x := Span(k, s, e, score(k, text, s, e))).score >= least]


def masked(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span's place taken by its kind in brackets; overlapping spans share that of the first."""
    if not text or not spans:
        return text
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if s.start >= at:
            out += [text[at : s.start], f"[{s.kind}]"]
        at = max(at, s.end)
    return "".join(out) + text[at:]


def find_personal(docs: DataFrame, least: float = 0.5, with_text: bool = False) -> DataFrame:
    """(doc_id, spans) of every row, and the masked text when `with_text`."""
    d = pick(docs, doc_id="doc_id", text="text")
    d = d.withColumn("doc_id", d["doc_id"].cast("long"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [detect(t, least) for t in texts]
            columns = [batch.column(0), pa.array([[s._asdict() for s in f] for f in found], kind)]
            if with_text:
                columns.append(pa.array([masked(t, f) for t, f in zip(texts, found, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "spans", "text"][: len(columns)])

    return d.mapInArrow(run, f"doc_id bigint, {COLUMNS}" + (", text string" if with_text else ""))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def personal_digest(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """A row per document: doc_id, counts and digest of the base spans, all spans as text, how many score 0.8 or more."""
    d = pick(docs, doc_id="doc_id", text="text")
    d = d.withColumn("doc_id", d["doc_id"].cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [detect(t, least) for t in batch.column(1).to_pylist()]
            base = [[s for s in f if s.kind in BASE] for f in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(pa.array([sum(s.kind == k for s in b) for b in base], pa.int64()) for k in BASE),
                    pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base], pa.string()),
                    pa.array([joined(f) for f in found], pa.string()),
                    pa.array([sum(s.score >= 0.8 for s in f) for f in found], pa.int64()),
                ],
                names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_likely"],
            )

    counts = ", ".join(f"n_{k} bigint" for k in BASE)
    return d.mapInArrow(run, f"doc_id bigint, {counts}, base_sha256 string, spans string, n_likely bigint")
