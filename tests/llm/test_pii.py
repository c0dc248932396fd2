"""Pseudonyms: values of any length, other scripts, and the query against a version written separately with the standard library's validators."""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
import time
import unicodedata
from math import isqrt

import pytest

from driftgauge.llm import pii
from driftgauge.llm import queries as Q

KEY = b"k"


# a version written separately: own detection, own validators, own networks ------------------------------------------
def _stream(key, *parts, n):
    raw = len(key).to_bytes(4, "big") + key
    for p in parts:
        p = p if isinstance(p, bytes) else str(p).encode()
        raw += len(p).to_bytes(8, "big") + p
    return hashlib.shake_256(raw).digest(n)


def _number(key, kind, size, x):
    rows = isqrt(size)
    rows += rows * rows < size
    cols = (size + rows - 1) // rows
    word = lambda r, v, n: int.from_bytes(_stream(key, kind, size, r, v, n=n.bit_length() // 8 + 17), "big")
    while True:
        i, j = x // cols, x % cols
        for r in (0, 2, 4, 6):
            i = (i + word(r, j, rows)) % rows
            j = (j + word(r + 1, i, cols)) % cols
        x = i * cols + j
        if x < size:
            return x


def _places(key, kind, x, size):
    if len(x) == 1:
        return [_number(key, kind, size[0], x[0])]
    pack = lambda v: b"".join(i.to_bytes(2, "little") for i in v)
    h = len(x) // 2
    for r in range(8):
        mine, other = (slice(h, None), slice(0, h)) if r % 2 else (slice(0, h), slice(h, None))
        add = _stream(key, kind, r, pack(size), pack(x[other]), n=2 * len(x[mine]))
        x = list(x)
        x[mine] = [(v + int.from_bytes(add[2 * i : 2 * i + 2], "little")) % m for i, (v, m) in enumerate(zip(x[mine], size[mine], strict=True))]
    return x


def _alphabet(c):
    block = ord(c) - ord(c) % 64
    return [d for d in map(chr, range(block, block + 64)) if d.isalnum() and unicodedata.category(d) == unicodedata.category(c)]


def _local(key, s):
    at = [i for i, c in enumerate(s) if c.isalnum() and len(_alphabet(c)) > 1]
    new = _places(key, "email", [_alphabet(s[i]).index(s[i]) for i in at], [len(_alphabet(s[i])) for i in at]) if at else []
    out = list(s)
    for i, v in zip(at, new, strict=True):
        out[i] = _alphabet(s[i])[v]
    return "".join(out)


def _into(shape, digits):
    digits = list(digits)
    return re.sub("[0-9]", lambda m: digits.pop(0), shape)


def _luhn(d):
    total = 0
    for i, c in enumerate(d[::-1]):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _card(key, s):
    d = re.sub("[ -]", "", s)
    if len(set(d)) == 1 or not _luhn(d):
        return None
    new = d
    while True:
        body = f"{_number(key, 'card', 10 ** (len(d) - 1), int(new[:-1])):0{len(d) - 1}d}"
        new = next(body + c for c in "0123456789" if _luhn(body + c))
        if len(d) < 17 or _luhn(d[:16]) == _luhn(new[:16]):
            return _into(s, new)


def _phone(key, s):
    codes = {"1": 1, "7": 1}
    head = ""
    if s.startswith("+"):
        digits = re.match(r"\+([0-9]+)", s)[1]
        head = "+" + digits[: codes.get(digits[0], 2 if digits[:2] in pii.TWO_DIGIT_CODES else 3)]
    d = re.sub("[^0-9]", "", s[len(head) :])
    return head + _into(s[len(head) :], str(_number(key, "phone", 10 ** len(d), int(d))).zfill(len(d))) if 7 <= len(d) <= 12 else None


def _ssn(key, s):
    area, group, serial = map(int, s.split("-"))
    if not (0 < area < 900 and area != 666 and group and serial):
        return None
    areas = [a for a in range(1, 900) if a != 666]
    x = _number(key, "ssn", 898 * 99 * 9999, (areas.index(area) * 99 + group - 1) * 9999 + serial - 1)
    return f"{areas[x // 9999 // 99]:03d}-{x // 9999 % 99 + 1:02d}-{x % 9999 + 1:04d}"


def _ip(key, s):
    try:
        return str(ipaddress.IPv4Address(_number(key, "ip", 2**32, int(ipaddress.IPv4Address(s)))))
    except ValueError:
        return None


def _date(key, s):
    first = datetime.date(1900, 1, 1)
    forms = ["%Y-%m-%d", "%Y/%m/%d", "%d.%m.%Y", "%m/%d/%Y"]
    if re.match("[0-9]{2}/", s) and int(s[:2]) > 12:
        forms = ["%d/%m/%Y"]
    for form in forms:
        try:
            day = datetime.datetime.strptime(s, form).date()
        except ValueError:
            continue
        n = (datetime.date(2100, 1, 1) - first).days
        return (first + datetime.timedelta(_number(key, "date", n, (day - first).days))).strftime(form) if 1900 <= day.year < 2100 else None
    return None


def _iban(key, s):
    as_number = lambda t: int("".join(str("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ".index(c)) for c in t))
    t = s.replace(" ", "")
    if as_number(t[4:] + t[:4]) % 97 != 1:
        return None
    d = re.sub("[^0-9]", "", t[4:])
    body = _into(t[4:], str(_number(key, "iban" + t[:2], 10 ** len(d), int(d))).zfill(len(d)))
    new = list(t[:2] + str(98 - as_number(body + t[:2] + "00") % 97).zfill(2) + body)
    return "".join(" " if c == " " else new.pop(0) for c in s)


FINDERS = [
    ("email", r"[\w.%+-]+(?=@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})", _local),
    ("secret", r"(?<=[^0-9A-Za-z])[0-9a-fA-F]{16,}(?![0-9A-Za-z])", lambda key, s: "".join(f"{v:x}" for v in _places(key, "secret", [int(c, 16) for c in s], [16] * len(s)))),
    ("iban", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])", _iban),
    ("card", r"(?<![0-9-])(?:[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{13,19})(?!-?[0-9])", _card),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", _ssn),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])", _ip),
    ("date", r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9/-])", _date),
    ("phone", r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9])|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-])", _phone),
]


def separately(text, key):
    found = []
    for kind, shape, work in FINDERS:
        for m in re.finditer(shape, text):
            s = m[0].lstrip("._%+-") if kind == "email" else m[0]
            if kind == "secret" and not re.search(r"(?i)(?:token|secret|password|passwd|pwd|api[_-]?key|key|bearer)\W{1,4}$", text[: m.start()]):
                continue
            if s and not any(a < m.end() and m.end() - len(s) < b for a, b, *_ in found) and (new := work(key, s)) is not None:
                found.append((m.end() - len(s), m.end(), kind, new.upper() if kind == "secret" and s != s.lower() else new))
    for a, b, _, new in sorted(found, reverse=True):
        text = text[:a] + new + text[b:]
    return text, {k: sum(f[2] == k for f in found) for k in pii.KINDS}


def test_query_against_the_separate_version(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = Q.op9_pii(spark, sf).collect()
    assert len(rows) == len(texts)
    total = 0
    for r in rows:
        new, counts = separately(texts[r.doc_id] or "", Q.KEY)
        assert (r.text or "") == new and {k: r[f"n_{k}"] for k in pii.KINDS} == counts, (texts[r.doc_id], r.text, new)
        total += sum(counts.values())
    assert total > 50


MIXED = [
    "Call +44 20 7946 0958 or +1 (017) 555-7713, born 29.02.2024, paid 4111-1111-1111-1111.", "IBAN DE89 3704 0044 0532 0130 00, GB29NWBK60161331926819; ssn 078-05-1120; host 10.0.0.254",
    "jane_doe+x@mail.example.com a@b.co, secret: DEADBEEF00112233DEADBEEF", "31/12/1999 12/31/1999 2001/02/03 1899-01-01", "иван.Петров7@mail.ru müller@web.de",
]


@pytest.mark.parametrize("text", MIXED)
def test_values_against_the_separate_version(text):
    new, found = pii.pseudonymised(text, KEY)
    assert (new, {k: sum(s.kind == k for s in found) for k in pii.KINDS}) == separately(text, KEY)
    assert pii.pseudonymised(new, KEY, back=True)[0] == text and len(found) >= 2


# long values ---------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("text", ["x" * 41 + "@a.com", "x" * 45 + "@a.com", "key: " + "0123456789abc" * 23 + "de", "key: " + "0f" * 64, "jane.doe" + "x" * 80 + "@a.com", "x" * 10**6 + "@a.com", "key: " + "a1" * 500_000])
def test_long_candidates(text):
    began = time.time()
    new, found = pii.pseudonymised(text, KEY)
    assert time.time() - began < 1 and len(found) == 1 and pii.pseudonymised(new, KEY, back=True)[0] == text
    assert found[0].end - found[0].start == len(text) - len("@a.com" if "@" in text else "key: ")
    a, b = text[found[0].start : found[0].end], found[0].new
    assert sum(x == y for x, y in zip(a, b, strict=True)) < len(a) / 3  # no stretch stays


@pytest.mark.parametrize("unit", ["1234567890", "1 0 ", "1-0-", "1.0.", "DE12 ", "+1 ", "a@", "@", "a.", "key: ", "4111 "])
def test_long_runs_of_candidates(unit):
    text = unit * (50_000 // len(unit))
    began = time.time()
    new, _ = pii.pseudonymised(text, KEY)
    assert time.time() - began < 3 and pii.pseudonymised(new, KEY, back=True)[0] == text


def test_secret_without_digits_and_other_scripts():
    new, found = pii.pseudonymised("key: " + "abcdef" * 6, KEY)
    assert [s.kind for s in found] == ["secret"] and "abcdef" * 2 not in new
    to = {48 + i: 0x660 + i for i in range(10)}
    for value, kind in (("078-05-1120", "ssn"), ("4111 1111 1111 1111", "card"), ("29.02.2024", "date"), ("192.168.17.254", "ip")):
        text = f"قبل {value.translate(to)} بعد"
        new, found = pii.pseudonymised(text, KEY)
        assert [s.kind for s in found] == [kind] and value.translate(to) not in new and pii.pseudonymised(new, KEY, back=True)[0] == text
        assert found[0].new == pii.spans(value, KEY)[0].new.translate(to)  # linked across scripts


def test_phones_are_linked_by_their_national_digits():
    national = {re.sub("[^0-9]", "", s.new)[-10:] for t in ("+1 (017) 555-7713", "(017) 555-7713", "017-555-7713", "+10175557713") for s in pii.spans(t, KEY)}
    assert len(national) == 1 and pii.spans("5551234567", KEY) == []


def test_networks_are_permutations():
    size = pii.np.array([10, 26, 3])
    every = [(a, b, c) for a in range(10) for b in range(26) for c in range(3)]
    new = [tuple(pii.permute_places(KEY, "t", pii.np.array(x), size).tolist()) for x in every]
    assert sorted(new) == every and all(tuple(pii.permute_places(KEY, "t", pii.np.array(y), size, True).tolist()) == x for x, y in zip(every, new, strict=True))
    n = 10**400 + 7  # halves much wider than one digest
    assert all(pii.permute(KEY, "t", n, pii.permute(KEY, "t", n, x), True) == x for x in (0, 1, n - 1, 10**399))
    a, b = (pii.permute(KEY, "t", n, x) for x in (12345, 12346))
    assert len(str(abs(a - b))) > 380
