import hashlib
import re
import time

import pytest
from hypothesis import given, settings, strategies as st

from rubrica.llm import personal
from tests.llm.conftest import rows

# --- the contract's patterns, tried as they stand ---
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number):
    total = 0
    for place, d in enumerate(reversed(number)):
        d = int(d) * (1 + place % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def passes(kind, text):
    n = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        return 13 <= len(n) <= 19 and luhn(n)
    return kind == "email" or 9 <= len(n) <= 15


def brute(text):
    return [(k, *m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes(k, m[0])]


def base(text):
    return [s[:3] for s in personal.detect(text) if s.kind in personal.BASE]


PIECES = st.sampled_from(["a", "B", "7", "0", "25", "256", "1.2.3.4", ".", "@", "-", " ", "+", "(", ")", "_", "%", "é", "x@y.z", "4111111111111111", "4111 1111-1111 1111", "+1 (743) 555-3824", "\n", "😀"])


@settings(max_examples=1500, deadline=None)
@given(st.lists(PIECES, max_size=30))
def test_base_against_plain_patterns(pieces):
    text = "".join(pieces)
    assert base(text) == brute(text)


CASES = {
    "mail a.b+c@d-e.example.com, x@y and @z.de": ["email:5:26"],
    "a@b.c@d.e a@b.c.@x.y": ["email:0:5", "email:10:15", "email:15:20"],
    "at 1.2.3.4.5.6.7.8, 256.1.1.1 and 0001.002.3.04": ["ip:3:10", "ip:11:18", "ip:34:47"],
    "4111 1111 1111 1111 4": [],
    "4111-1111-1111-1111x": ["card:0:19"],
    "call +1 (743) 555-3824.": ["phone:5:22"],
    "+12345678 and +1234567890123456": [],
    "IBAN DE89 3704 0044 0532 0130 00.": ["iban:5:32"],
    "DE89370400440532013000 DE89370400440532013001 DE8937040044053201300": ["iban:0:22"],
    "her ssn is 123-45-6789": ["ssn:11:22"],
    "her ssn, order 123-45-6789": [],
    "the number 123-45-6789": [],
    "phone: 0711 555 3824; code 0711 555 3824 of something else that has nothing to do with the matter at hand": ["local_phone:7:20", "local_phone:27:40"],
    "part 0711 555 3824": [],
    "": [],
}


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    assert personal.joined(personal.detect(text)) == ",".join(CASES[text])


def test_context_moves_the_score():
    plain, raised, lowered = (personal.detect(t)[0].score for t in ("10.1.2.3", "server 10.1.2.3", "version 10.1.2.3"))
    assert lowered < plain < raised
    assert personal.near("prefixserver " + "x" * 42 + " 10.1.2.3", 56, 64) == {"x" * 42}  # a cut word is no word


def test_masking():
    text = "mail a@b.de or call +1 (743) 555-3824"
    assert personal.masked(text, personal.detect(text)) == "mail [email] or call [phone]"
    assert personal.masked(None, []) is None


@pytest.mark.parametrize("unit", ["a", "1", "@", "+", ".", "1.", "+1", "a@", "1 ", "+(", "AB12", "a.b@c.", "123-", "0711 "])
def test_long_texts_take_linear_time(unit):
    begun = time.perf_counter()
    personal.detect(unit * (2_000_000 // len(unit)))
    assert time.perf_counter() - begun < 20


def test_table(docs):
    texts = ["a@b.de 1.2.3.4", None, "", "no data", "a@b.de 1.2.3.4", "x" * 100_000 + " a@b.de"]
    got = {r["doc_id"]: r for r in personal.personal_digest(docs(texts, ids=[0, 1, 2, 3, None, 5])).collect()}
    none = hashlib.sha256(b"").hexdigest()
    assert got[0]["spans"] == "email:0:6,ip:7:14" and (got[0]["n_email"], got[0]["n_ip"], got[0]["n_card"], got[0]["n_phone"]) == (1, 1, 0, 0)
    assert got[0]["base_sha256"] == hashlib.sha256(b"email:0:6,ip:7:14").hexdigest() == got[None]["base_sha256"]
    assert all(got[i]["base_sha256"] == none and got[i]["spans"] == "" for i in (1, 2, 3))
    assert got[5]["spans"] == "email:100001:100007"
    assert rows(personal.personal_digest(docs([]))) == []
    full = rows(personal.find_personal(docs(["call +1 (743) 555-3824"]), with_text=True))
    assert full[0][2] == "call [phone]" and full[0][1][0]["kind"] == "phone"


def test_documents(llm):
    table = llm.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    got = {r["doc_id"]: r["base_sha256"] for r in personal.personal_digest(table).collect()}
    for r in table.collect():
        assert got[r["doc_id"]] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in brute(r["text"])).encode()).hexdigest()
