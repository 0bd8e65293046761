import hashlib
import random
import re

from verdigris.llm import pii

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
ODD = [
    (1, None), (2, ""), (3, "a@b.c%d@e.f x@y a@b..c @b.c"), (4, "1.2.3.4.5 256.1.1.1 001.002.003.0255 00.0.0.0 9.9.9.9999999999999"),
    (5, "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111 7"), (6, "+1 (743) 555-3824 +49 30 1234567- +1 2 +12345678901234567"),
    (7, "é😀 mail é@x.io me@x.io 😀+44 20 7946 0958"), (8, "x" * 60_000 + "@"), (9, "a@" + "b." * 20_000 + "c"), (10, "1" * 50_000),
    (11, "account DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432 not GB82WEST12345698765433"),
    (12, "my ssn is 123-45-6789"), (13, "part 123-45-6789"), (14, ("call +1 (743) 555-3824, " * 300)), (14, "me@x.io"), (None, "me@x.io"),
]


def luhn(digits):
    total = sum(sum(divmod(int(c) * 2, 10)) if k % 2 else int(c) for k, c in enumerate(reversed(digits)))
    return total % 10 == 0


def brute(text):
    spans = []
    for kind, pattern in BASE.items():
        for m in pattern.finditer(text or ""):
            digits = re.sub(r"[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            spans.append((kind, m.start(), m.end()))
    return spans


def check(docs, rows):
    found = pii.digest(pii.find_pii(docs)).collect()
    expected = []
    for i, text in rows:
        spans = brute(text)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        counts = [sum(s[0] == kind for s in spans) for kind in BASE]
        expected.append((i, *counts, hashlib.sha256(joined.encode()).hexdigest(), joined))
    order = lambda row: tuple(str(x) for x in row)
    got = [
        (*row[:6], ",".join(s for s in row.spans.split(",") if s.split(":")[0] in BASE)) for row in found
    ]
    assert sorted(got, key=order) == sorted(expected, key=order)
    return found


def test_base_spans_equal_brute_force(make, sample):
    check(*sample)
    found = check(make(ODD, clash=("spans", "score", "kind")), ODD)
    more = {row.doc_id: row.spans for row in found if row.doc_id in (11, 12, 13)}
    assert (more[12], more[13]) == ("ssn:10:21", "")
    assert [s.split(":")[0] for s in more[11].split(",")] == ["iban", "iban"]


def test_random_texts(make):
    rnd = random.Random(7)
    alphabet = ["1", "2", "25", ".", ".", "-", " ", "+", "@", "a", "B", "é", "(", ")", "x.y", "😀"]
    rows = [(i, "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 80)))) for i in range(400)]
    check(make(rows), rows)


def test_context_raises_the_score(make):
    found = pii.digest(pii.find_pii(make([(1, "call +44 20 7946 0958"), (2, "zzz +44 20 7946 0958"), (3, "no")])))
    score = {row.doc_id: row.score for row in found.collect()}
    assert score[1] > score[2] > score[3] == 0


def test_redaction(make):
    rows = [(1, "é me@x.io, +44 20 7946 0958!"), (2, None), (3, "clean"), (4, "5500 0000 0000 0004"), (None, "é me@x.io")]
    docs = make(rows, clash=("spans",))
    out = pii.redact(docs)
    assert out.columns == docs.columns
    got = {row.doc_id: (row.text, row.n_chars) for row in out.collect()}
    assert got == {
        1: ("é [EMAIL], [PHONE]!", 19), 2: (None, None), 3: ("clean", 5), 4: ("[CARD]", 6), None: ("é [EMAIL]", 9),
    }
    assert pii.redact(make([])).count() == 0
    assert pii.find_pii(make([])).count() == 0


def test_ibans_end_where_their_number_does(make):
    german, british = "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"
    rows = [
        (1, f"IBAN {german} BIC COBADEFF"), (2, "DE89370400440532013000 BIC COBADEFFXXX"), (3, f"é {british} 2 copies"),
        (4, f"{german} {british} {german}"), (5, f"AT12 {german} 7"), (6, f"{british}9 {british}X"), (7, f"({german})"),
        (8, "NO9386011117947 OK 15"), (9, "ZZ23WEST12345698765432 AND MORE"),
    ]
    numbers = {i: [text[int(a) : int(b)] for k, a, b in spans] for i, text, spans in _ibans(make, rows)}
    assert numbers == {
        1: [german], 2: ["DE89370400440532013000"], 3: [british], 4: [german, british, german], 5: [german], 6: [], 7: [german],
        8: ["NO9386011117947"], 9: [_passing("ZZ", "WEST12345698765432")],
    }
    clean = {row.doc_id: row.text for row in pii.redact(make(rows[:3])).collect()}
    assert clean == {1: "IBAN [IBAN] BIC COBADEFF", 2: "[IBAN] BIC COBADEFFXXX", 3: "é [IBAN] 2 copies"}


def _passing(country, rest):
    number = int("".join(str(int(c, 36)) for c in rest + country + "00"))
    return f"{country}{98 - number % 97:02}{rest}"


def _ibans(make, rows):
    rows[-1] = (9, _passing("ZZ", "WEST12345698765432") + " AND MORE")
    for row in pii.digest(pii.find_pii(make(rows))).collect():
        spans = [s.split(":") for s in row.spans.split(",") if s.startswith("iban")]
        yield row.doc_id, dict(rows)[row.doc_id], spans
