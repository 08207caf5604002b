from __future__ import annotations

import hashlib
import random
import re
import time

import pytest

from notewright.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(t):
    t, out = t or "", []
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    out += [("phone", *m.span()) for m in PHONE.finditer(t) if 10 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.ORDER[s[0]]))


def test_base_kinds_against_patterns():
    r = random.Random(3)
    for _ in range(40_000):
        t = "".join(r.choice("ab.@-+ 0129()%_é\n4") for _ in range(r.randint(0, 40)))
        assert pii.find(t)[0] == brute(t), t
    for t in ("4111 1111 1111 1111", "x@y.z@w.v", "a@b", "1.2.3.4.5.6.7.8", "999.1.1.1 1.1.1.1", "+1 (555) 010-9999.", "😀 a@b.co"):
        assert pii.find(t)[0] == brute(t), t


def test_added_kinds():
    kinds = lambda t: [(k, t[a:b]) for k, a, b in pii.find(t)[1]]
    assert kinds("IBAN: DE89 3704 0044 0532 0130 00, ok") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert kinds("IBAN: DE89 3704 0044 0532 0130 01") == []
    assert kinds("SSN 078-05-1120") == [("ssn", "078-05-1120")] and kinds("SSN 000-05-1120") == []
    assert kinds("Account number: 12345678") == [("account", "12345678")]
    assert kinds('token = "7f5790b897549d620aedfc0705a565f96e3741e8"') == [("secret", "7f5790b897549d620aedfc0705a565f96e3741e8")]
    assert kinds("see https://example.com/a and tokens of love, my account is old") == []
    assert kinds("https://user:pw@localhost/x") and not kinds("mytoken = aaaaaaaaaaaaaaaaaaaaaaaa1")


def test_cues_in_any_spelling():
    kinds = lambda t: [(k, t[a:b]) for k, a, b in pii.find(t)[1]]
    key = "Ab1" * 8
    for cue in ("API key", "API_key", "apiKey", "api-key", "Secret Key", "ACCESS KEY", "Token"):
        assert kinds(f"{cue}: {key}") == [("secret", key)], cue
    assert kinds("Password: hunter2!x") == [("secret", "hunter2!x")] and kinds("passwd=abc12 x") == [] and kinds("the password is: secret") == []
    assert kinds("NUMÉRO DE COMPTE 12345678") == [("account", "12345678")]
    assert kinds("Address: 12 Old Mill Road, Springfield, IL 62704. Next") == [("address", "12 Old Mill Road, Springfield, IL 62704")]
    assert kinds("Anschrift: Lange Hauptstraße 12a, 10115 und") == [("address", "Lange Hauptstraße 12a, 10115")]
    assert kinds("adresse: 5 rue de la Paix, 75002") == [("address", "5 rue de la Paix, 75002")]
    assert kinds("an address to the nation in 1999 and 3 addresses") == []
    assert kinds("ftp://a/http://u:p@h/x.") == [("url", "http://u:p@h/x")]


@pytest.mark.parametrize(
    "piece", ["7", "0", "1.", "1.1.1.1.", "0" * 50 + ".", "1 ", "+1", "+1(", "a@", "a@b.c", "@", "a", "http://a/", "http://u@h/", "iban ", "token=", "token=" + "a1" * 12 + " ", "address: 1 a ", "account 123456 ", "ssn ", "password:a1"]
)
def test_time_grows_with_the_text(piece):
    """A megabyte of anything is done in seconds; nothing is tried again from every place of a run."""
    text = piece * (1_000_000 // len(piece))
    began = time.perf_counter()
    pii.find(text)
    assert time.perf_counter() - began < 20


def test_long_runs_of_digits():
    assert pii.find("0" * 5000 + ".1.1.1")[0] == [("ip", 0, 5006)]
    assert pii.find("9" * 5000 + ".1.1.1 " + "1.2.3.4" + "5" * 5000)[0] == [] and pii.find("1.2.3.4." * 3)[0] == [("ip", 8 * i, 8 * i + 7) for i in range(3)]


def test_report_and_redaction(documents, rows):
    texts = [None, "", "mail a.b@c.de and +1 (555) 010-9999", "é" * 100_000 + " x@y.zz", "none"]
    docs = documents([(i, t, "s") for i, t in enumerate(texts)])
    got = {r["doc_id"]: r for r in pii.report(docs).collect()}
    for i, t in enumerate(texts):
        base = brute(t)
        assert got[i]["base_sha256"] == hashlib.sha256(pii.join(base).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.BASE_KINDS] == [sum(s[0] == k for s in base) for k in pii.BASE_KINDS]
    clean = dict(rows(pii.redact(docs), "doc_id", "text"))
    assert clean[2] == "mail [email] and [phone]" and clean[0] is None and clean[4] == "none"
    assert pii.redact(docs).columns == docs.columns and pii.report(documents([])).count() == 0
