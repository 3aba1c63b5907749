"""Spans against a plain reading of the rules with Python's re."""

import hashlib
import random
import re

import pytest

from faintline.llm import pii

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def good(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": all(int(p) <= 255 for p in m.split(".")) if kind == "ip" else 0, "card": 12 <= len(d) <= 19 and luhn(d or "1"), "phone": 9 <= len(d) <= 15}[kind]


def base(text):
    found = [(m.start(), list(RULES).index(k), k, m.end()) for k, p in RULES.items() for m in re.finditer(p, text or "") if good(k, m[0])]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found))


def texts():
    rnd = random.Random(5)
    bits = ["a@b.co", "x.y+z@host-1.example.org", "1.2.3.4", "256.1.1.1", "010.0.0.255.7", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (0)30 1234567", "+1", "é", "😀", " ", "@", ".", "_c@d.ef", "12", "+123456789012", "GB82 WEST 1234 5698 7654 32", "card ", "\n", "5500005555555559", "a@b", "999.", "-", "(3)"]
    out = [None, "", " ", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "+1 555 1234567@x.com", "+123456789012(3)"]
    out += ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 30))) for _ in range(400)]
    out += ["1 " * 20000, "a" * 60000, "1" * 60000, "😀1.2.3.4 a@b.co " * 1500]
    return out


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, t, i * 2) for i, t in enumerate(texts())]
    return data, spark.createDataFrame(data, "doc_id long, text string, spans long").repartition(4)


def test_base_spans(rows):
    data, df = rows
    got = {r.doc_id: r for r in pii.report(df.drop("spans")).collect()}
    for i, t, _ in data:
        want = base(t)
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (t or "")[:200]
        assert [got[i][f"n_{k}"] for k in RULES] == [want.count(k) for k in RULES]


def test_added_kind_and_context(spark):
    df = spark.createDataFrame([(1, "my card 4111 1111 1111 1111 and IBAN GB82 WEST 1234 5698 7654 32 ok"), (2, "4111111111111111"), (3, "GB82 WEST 1234 5698 7654 33")], "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.score) for s in r.spans] for r in pii.find(df).collect()}
    assert got[2] == [("card", 0.7)] and got[3] == []
    assert [k for k, _ in got[1]] == ["card", "iban"] and all(s > 0.85 for _, s in got[1])


def test_iban_before_upper_case_and_digits(spark):
    ibans = ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "NO9386011117947", "FR14 2004 1010 0505 0001 3M02 606", "MT84MALT011000012345MTLCAST001S"]
    after = [" BIC COBADEFFXXX", " VISA", " 2024", " 1 500 EUR", "", ", paid", " GB29NWBK60161331926819"]
    rows = [(n, f"IBAN {i}{a}", i) for n, (i, a) in enumerate((i, a) for i in ibans for a in after)]
    df = spark.createDataFrame(rows, "doc_id long, text string, iban string").coalesce(1)
    for r in pii.find(df).collect():
        found = [(s.start, s.end) for s in r.spans if s.kind == "iban"]
        assert found[:1] == [(5, 5 + len(r.iban))] and len(found) == 1 + r.text.endswith(after[-1]), r.text
    assert {r.text for r in pii.redact(df.filter("doc_id = 0")).collect()} == {"IBAN [IBAN] BIC COBADEFFXXX"}
    bad = spark.createDataFrame([(1, "DE89370400440532013001 BIC"), (2, "DE89370400440532013000X BIC"), (3, "XDE89370400440532013000")], "doc_id long, text string")
    assert not any(r.spans for r in pii.find(bad).collect())


def test_redaction_leaves_nothing_and_keeps_the_rest(rows):
    data, df = rows
    got = {r.doc_id: r for r in pii.redact(df).collect()}
    for i, t, x in data:
        spans = sorted(tuple(map(int, s.split(":")[1:])) for s in base(t).split(",") if s)
        assert got[i].spans == x
        if not spans and "GB82" not in (t or ""):
            assert got[i].text == t
        for s, e in spans:
            if e - s > 8 and t.count(t[s:e]) == 1:
                assert t[s:e] not in got[i].text
    assert got[4].text == "[IP].[IP]" and got[3].text == "[EMAIL][EMAIL]"


def test_ids_and_secrets(spark):
    dni = lambda n: f"{n:08d}" + "TRWAGMYFPDXBNJZSQVHLCKE"[n % 23]
    nir = lambda n: f"{n}{97 - n % 97:02d}"
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    good = [(dni(12345678), "id", 70), ("X-" + dni(1234567)[1:], "id", 70), ("dni " + dni(87654321), "id", 90), (nir(2550814168025), "id", 70), ("AKIA" + "ABCD1234" * 2, "secret", 80), (f'token = "{key}"', "secret", 55), (f"sha {key}", "secret", 35), ("ghp_" + "aB3" * 12, "secret", 80)]
    rows = [(i, f"see {t}, ok", k, n) for i, (t, k, n) in enumerate(good)]
    bad = [dni(12345678)[:-1] + "A", str(2550814168025) + "11", "0" * 40, "a" * 40, key + key * 3, "x" + key, "AKIAshort"]
    df = spark.createDataFrame(rows, "doc_id long, text string, of_id string, of_secret int")
    for r in pii.find(df).collect():
        assert [(s.kind, round(100 * s.score)) for s in r.spans if s.kind in ("id", "secret")] == [(r.of_id, r.of_secret)], r.text
    hidden = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert hidden[5] == 'see token = "[SECRET]", ok' and hidden[6] == rows[6][1]  # by its score alone a bare number stays
    found = pii.find(spark.createDataFrame([(i, f"see {t}, ok") for i, t in enumerate(bad)], "doc_id long, text string")).collect()
    assert not [(r.text, s) for r in found for s in r.spans if s.kind in ("id", "secret")]
    reported = pii.report(df).filter("doc_id = 6").first()
    assert reported.scores == "35" and reported.n_likely == 0


def test_empty_table(spark):
    assert pii.report(spark.createDataFrame([], "doc_id long, text string")).collect() == []
