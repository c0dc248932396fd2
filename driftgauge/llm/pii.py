"""Personal numbers, dates and addresses replaced by format-preserving Feistel pseudonyms.

A candidate is replaced only once it is validated: payment cards and IBANs by their check digits, social security
numbers by their ranges, dates by the calendar (1900 to 2099), IP addresses by their octets, phone numbers by their
grouping; the local parts of e-mail addresses and hexadecimal secrets behind a naming word follow the same way. Its
canonical value (digits without separators, day number) is permuted within its kind and length by a keyed Feistel
network with cycle walking, check digits are computed anew, and the result is written back in the format found.
Local parts and secrets, which have any length, go through a Feistel network over their characters: one half is added to
by a keyed stream of the other's, each character modulo its own alphabet, so time and memory grow with the length.

What is linked: equal cards, IBANs, social security numbers, IP addresses and secrets, however grouped or spaced; equal
dates in all forms; equal local parts, letter case apart from case; phone numbers by their national digits (behind ``+``, the
country code of ITU E.164 stays in clear), so ``+1 (017) 555-7713`` and ``(017) 555-7713`` differ in the code only.
What isn't found and stays in clear: phone numbers without separators and code (``5551234567``) or with dots (``555.123.4567``), secrets that
aren't hexadecimal or begin with ``0x``, IP addresses of version 6, e-mail addresses whose domain isn't ASCII.
Whoever holds the key can invert each permutation; a secret in mixed case comes back in one case.

A card or IBAN may stand in a run of digits or groups that goes on behind it, as in ``4111 1111 1111 1111 12/25``: what is valid in a customary
grouping (IBAN: of its country's length) is taken first, then the whole run, then its shorter beginnings up to a border between groups.
A value that is taken although something else is tried before it is permuted so that the rest still fails; that can't be linked
to the same value elsewhere if its first pseudonym won't do. All others are.

Defined results: null and empty texts stay as they are; numbers that fail validation stay; texts are read whole, and
candidates of any length in time that grows with it. Decimal digits of other scripts are read as 0 to 9 and written back in
their script. Repeated rows are treated each for itself and alike; an empty table gives an empty one; other columns stay, but for those
named like a new one, which give way to it. A letter of a local part is replaced within the letters of its general category in its block of 64 code points (a-z, A-Z,
0-9, and alike in other scripts); one without another such letter stays. The order of kinds at the same place is fixed.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
import unicodedata
from bisect import bisect_left
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ._common import beside, map_texts

ROUNDS = 8


def _stream(key: bytes, *parts: object, n: int) -> bytes:
    """``n`` bytes that the key and the parts decide."""
    h = hashlib.shake_256(len(key).to_bytes(4, "big") + key)
    for p in parts:
        raw = p if isinstance(p, bytes) else str(p).encode()
        h.update(len(raw).to_bytes(8, "big") + raw)
    return h.digest(n)


@lru_cache(100_000)
def permute(key: bytes, kind: str, size: int, x: int, back: bool = False) -> int:
    """The keyed permutation of 0 .. size - 1 that ``kind`` names; ``back`` inverts it."""
    if size < 2:
        return x
    a = math.isqrt(size - 1) + 1
    b = -(-size // a)

    def mix(r: int, v: int, n: int) -> int:  # 16 bytes more than n has, so that remainders are even
        return int.from_bytes(_stream(key, kind, size, r, v, n=n.bit_length() // 8 + 17), "big") % n

    while True:
        left, right = divmod(x, b)
        for r in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
            sign = -1 if back else 1
            if r % 2:
                right = (right + sign * mix(r, left, b)) % b
            else:
                left = (left + sign * mix(r, right, a)) % a
        x = left * b + right
        if x < size:
            return x


def permute_places(key: bytes, kind: str, x: np.ndarray, size: np.ndarray, back: bool = False) -> np.ndarray:
    """The keyed permutation of vectors whose place i holds 0 .. size[i] - 1: a Feistel network over both halves of the places."""
    if len(x) == 1:
        return np.array([permute(key, kind, int(size[0]), int(x[0]), back)], np.int64)
    half = len(x) // 2
    sides, sizes = [x[:half].astype(np.int64), x[half:].astype(np.int64)], [size[:half], size[half:]]
    shape = size.astype("<u2").tobytes()
    for r in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
        to, by = r % 2, 1 - r % 2
        add = np.frombuffer(_stream(key, kind, r, shape, sides[by].astype("<u2").tobytes(), n=2 * len(sides[to])), "<u2").astype(np.int64)
        sides[to] = (sides[to] - add if back else sides[to] + add) % sizes[to]
    return np.concatenate(sides)


_TWICE = bytes(sum(divmod(2 * (i - 48), 10)) if 48 <= i < 58 else 0 for i in range(256))


def luhn_digit(digits: str) -> str:
    """The check digit that belongs behind ``digits``."""
    raw = digits.encode()
    plain = raw[-2::-2]
    return str(-(sum(raw[::-2].translate(_TWICE)) + sum(plain) - 48 * len(plain)) % 10)


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _poured(shape: str, digits: str) -> str:
    """``digits`` in the places that digits have in ``shape``."""
    it = iter(digits)
    return "".join(next(it) if "0" <= c <= "9" else c for c in shape)


def card(key: bytes, s: str, back: bool = False) -> str | None:
    d = _digits(s)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    n, begins = len(d) - 1, lambda x: len(x) > 16 and luhn_digit(x[:15]) == x[15]
    new = d
    while True:  # numbers over 16 digits stay with those that begin with a valid one of 16, or with the others, so that they read alike in groups
        new = f"{permute(key, 'card', 10**n, int(new[:-1]), back):0{n}d}"
        new += luhn_digit(new)
        if begins(new) == begins(d):
            return _poured(s, new)


#: The country codes of two digits (ITU E.164); 1 and 7 have one digit, all others three.
TWO_DIGIT_CODES = set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def phone(key: bytes, s: str, back: bool = False) -> str | None:
    head = ""
    if s[0] == "+":
        own = re.match(r"[0-9]+", s[1:])[0]
        head = s[: 1 + min(len(own), 1 if own[0] in "17" else 2 if own[:2] in TWO_DIGIT_CODES else 3)]
    d = _digits(s[len(head) :])
    if not 7 <= len(d) <= 12:
        return None
    return head + _poured(s[len(head) :], f"{permute(key, 'phone', 10 ** len(d), int(d), back):0{len(d)}d}")


def ssn(key: bytes, s: str, back: bool = False) -> str | None:
    a, g, n = int(s[:3]), int(s[4:6]), int(s[7:])
    if a in (0, 666) or a >= 900 or not g or not n:
        return None
    x = permute(key, "ssn", 898 * 99 * 9999, ((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + n - 1, back)
    rest, n = divmod(x, 9999)
    a, g = divmod(rest, 99)
    return _poured(s, f"{a + 1 + (a >= 665):03d}{g + 1:02d}{n + 1:04d}")


def address(key: bytes, s: str, back: bool = False) -> str | None:
    o = s.split(".")
    if any(int(x) > 255 or len(x) > 1 and x[0] == "0" for x in o):
        return None
    x = permute(key, "ip", 1 << 32, sum(int(v) << 8 * i for i, v in enumerate(reversed(o))), back)
    return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))


FIRST = datetime.date(1900, 1, 1).toordinal()
DAYS = datetime.date(2100, 1, 1).toordinal() - FIRST


def date(key: bytes, s: str, back: bool = False) -> str | None:
    sep = s[4] if s[4:5] in ("-", "/", ".") else next(c for c in s if c in "-/.")
    p = s.split(sep)
    if len(p) != 3:
        return None
    places = (0, 1, 2) if len(p[0]) == 4 else (2, 0, 1) if sep == "/" and int(p[0]) <= 12 else (2, 1, 0)
    try:
        day = datetime.date(*(int(p[i]) for i in places)).toordinal() - FIRST
    except ValueError:
        return None
    if not 0 <= day < DAYS:
        return None
    new = datetime.date.fromordinal(FIRST + permute(key, "date", DAYS, day, back))
    # a month-first date must not turn into what reads day first: both are taken from the same three numbers
    out = dict(zip(places, (f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}"), strict=True))
    return sep.join(out[i] for i in range(3))


_AS_NUMBERS = {c: str(int(chr(c), 36)) for c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def iban(key: bytes, s: str, back: bool = False) -> str | None:
    t = s.replace(" ", "")
    value = lambda x: int(x.translate(_AS_NUMBERS))
    if not 15 <= len(t) <= 34 or value(t[4:] + t[:4]) % 97 != 1:
        return None
    d = _digits(t[4:])
    if not d:
        return None
    body = _poured(t[4:], f"{permute(key, 'iban' + t[:2], 10 ** len(d), int(d), back):0{len(d)}d}")
    t = t[:2] + f"{98 - value(body + t[:2] + '00') % 97:02d}" + body
    it = iter(t)
    return "".join(c if c == " " else next(it) for c in s)


#: Groups in which cards are customarily written, besides one group of 13 to 19 digits.
GROUPED = ([4, 4, 4, 4], [4, 6, 5], [4, 6, 4])
#: Lengths of IBANs by country.
IBAN_LENGTHS = dict(
    x.split(":")
    for x in """AD:24 AE:23 AL:28 AT:20 AZ:28 BA:20 BE:16 BG:22 BH:22 BI:27 BR:29 BY:28 CH:21 CR:22 CY:28 CZ:24 DE:22 DJ:27 DK:18 DO:28 EE:20 EG:29 ES:24 FI:18 FK:18
    FO:18 FR:27 GB:22 GE:22 GI:23 GL:18 GR:27 GT:28 HN:28 HR:21 HU:28 IE:22 IL:23 IQ:23 IS:26 IT:27 JO:30 KW:30 KZ:20 LB:28 LC:32 LI:21 LT:20 LU:20 LV:21 LY:25 MC:27 MD:24
    ME:22 MK:19 MN:20 MR:27 MT:31 MU:30 NI:28 NL:18 NO:15 OM:23 PK:24 PL:28 PS:29 PT:25 QA:29 RO:24 RS:22 RU:33 SA:24 SC:31 SD:18 SE:24 SI:19 SK:24 SM:27 SO:23 ST:25 SV:28
    TL:23 TN:24 TR:26 UA:29 VA:22 VG:24 XK:20 YE:30""".split()
)


def _card_places(s: str) -> list[tuple[int, int]]:
    """Where a card may be in a run of digits, in the order in which they are tried."""
    g = [m.span() for m in re.finditer(r"[0-9]+", s)]
    size = [b - a for a, b in g]
    natural = [(g[i][0], g[i + n - 1][1]) for i in range(len(g)) for n in (1, 3, 4) if i + n <= len(g) and size[i : i + n] in GROUPED or n == 1 and 13 <= size[i] <= 19]
    return [*natural, *((0, g[i][1]) for i in range(len(g) - 1, -1, -1) if sum(size[: i + 1]) >= 13)]


def _iban_places(s: str) -> list[tuple[int, int]]:
    """The same for the beginnings of what looks like an IBAN."""
    ends = [m.start() for m in re.finditer(r" |\Z", s)][::-1]
    own = [e for e in ends if str(e - s.count(" ", 0, e)) == IBAN_LENGTHS.get(s[:2])]
    return [(0, e) for e in own + ends]


_PLACES = {"card": _card_places, "iban": _iban_places}


@lru_cache(4096)
def _alphabet(block: int) -> dict[str, tuple[int, str]]:
    """Of a block of 64 code points: each letter's and digit's place among those of its general category, and these."""
    kinds: dict[str, str] = {}
    for c in map(chr, range(block * 64, block * 64 + 64)):
        if c.isalnum():
            kinds[unicodedata.category(c)] = kinds.get(unicodedata.category(c), "") + c
    return {c: (i, all_) for all_ in kinds.values() for i, c in enumerate(all_)}


def letters(key: bytes, s: str, kind: str, back: bool = False) -> str:
    """Letters and digits of ``s`` permuted within their alphabets; its other characters stay."""
    own, at = np.unique(np.frombuffer(s.encode("utf-32-le"), "<u4"), return_inverse=True)
    held = [_alphabet(int(c) // 64).get(chr(c), (0, chr(c))) for c in own]
    size = np.array([len(h[1]) for h in held])[at]
    moves = size > 1
    if not moves.any():
        return s
    table = np.zeros((len(own), 64), "<u4")
    for row, (_, alphabet) in zip(table, held, strict=True):
        row[: len(alphabet)] = [ord(c) for c in alphabet]
    place = np.array([h[0] for h in held])[at]
    place[moves] = permute_places(key, kind, place[moves], size[moves], back)
    return table[at, place].tobytes().decode("utf-32-le")


def secret(key: bytes, s: str, back: bool = False) -> str | None:
    """Hexadecimal digits, in the case found."""
    upper = any(c in s for c in "ABCDEF")
    raw = np.frombuffer(s.lower().encode(), np.uint8).astype(np.int64)
    new = permute_places(key, "secret", np.where(raw < 58, raw - 48, raw - 87), np.full(len(s), 16), back)
    out = np.where(new < 10, new + 48, new + 87).astype(np.uint8).tobytes().decode()
    return out.upper() if upper else out


#: What may be personal, in the order in which they are tried at one place.
SHAPES = {
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,3}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])",
    "date": r"(?<![\d.])\d{4}-\d{2}-\d{2}(?![\d-])|(?<![\d./])\d{4}/\d{2}/\d{2}(?![\d/])|(?<![\d/])\d{2}/\d{2}/\d{4}(?![\d/])|(?<![\d.])\d{2}\.\d{2}\.\d{4}(?![\d.]*\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)",
    "card": r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-]*\d)",
}
_SHAPES = re.compile("|".join(f"(?P<{k}>{v})" for k, v in SHAPES.items()), re.ASCII)
_EACH = {k: re.compile(v, re.ASCII) for k, v in SHAPES.items()}
_DIGIT, _RUN, _OTHER_DIGIT = re.compile("[0-9]"), re.compile("[0-9]*"), re.compile(r"[^\D0-9]")
_SECRET = re.compile(r"(?i)(?:token|secret|password|passwd|pwd|api[_-]?key|key|bearer)\W{1,4}([0-9a-f]{16,})(?![0-9a-z])")
_DOMAIN = re.compile(r"@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.)+[A-Za-z]{2,24}")
_WORK = {"card": card, "phone": phone, "ssn": ssn, "ip": address, "date": date, "iban": iban}
KINDS = [*SHAPES, "email", "secret"]


def _replaced(key: bytes, kind: str, s: str, back: bool) -> tuple[int, int, str] | None:
    """(start, end, new) of what is valid in ``s``, the match of a kind's shape, or None."""
    work = _WORK[kind]
    if kind not in _PLACES:
        return None if (new := work(key, s, back)) is None else (0, len(s), new)
    places = _PLACES[kind](s)
    for i, (a, b) in enumerate(places):
        if (new := work(key, s[a:b], back)) is not None:
            # the new text must be read in the same place; walking on within those that are keeps the permutation invertible
            while any(work(key, (s[:a] + new + s[b:])[c:d]) is not None for c, d in places[:i] if (c, d) != (a, b)):
                new = work(key, new, back)
            return a, b, new
    return None


@dataclass(frozen=True)
class Span:
    start: int
    end: int
    kind: str
    new: str


def _plain_digits(text: str) -> str:
    """``text`` with decimal digits of any script as 0 to 9; each stays one character."""
    return text if text.isascii() or not _OTHER_DIGIT.search(text) else _OTHER_DIGIT.sub(lambda m: str(unicodedata.decimal(m[0])), text)


def _in_script(new: str, was: str) -> str:
    """``new`` in the digits in which ``was`` is written, if they are of one script."""
    zeros = {ord(c) - unicodedata.decimal(c) for c in was if c.isdecimal()}
    return new if len(zeros) != 1 or zeros == {48} else new.translate({48 + i: min(zeros) + i for i in range(10)})


def spans(text: str, key: bytes, back: bool = False) -> list[Span]:
    """What is replaced by what, in order and without overlap; ``back`` inverts."""
    found: list[Span] = []
    at = text.find("@")
    while at >= 0:
        if m := _DOMAIN.match(text, at):
            a = at
            while a > 0 and (text[a - 1].isalnum() or text[a - 1] in "._%+-"):
                a -= 1
            while a < at and not text[a].isalnum():
                a += 1
            if a < at:
                found.append(Span(a, at, "email", letters(key, text[a:at], "email", back)))
            at = text.find("@", m.end())
        else:
            at = text.find("@", at + 1)
    mails = [(s.start, s.end) for s in found]
    found += [Span(m.start(1), m.end(1), "secret", secret(key, m[1], back)) for m in _SECRET.finditer(text) if not _over(mails, *m.span(1))]
    plain = _plain_digits(text)
    if not _DIGIT.search(plain):  # every shape has a digit
        return sorted(found, key=lambda s: s.start)
    taken = sorted((s.start, s.end) for s in found)
    at = 0
    while m := _SHAPES.search(plain, at):
        kind = m.lastgroup
        done = _replaced(key, kind, m[0], back)
        if done is None and kind != "card":  # another kind may begin there
            for k in [k for k in SHAPES if k != kind]:
                if (o := _EACH[k].match(plain, m.start())) and (done := _replaced(key, k, o[0], back)) is not None:
                    kind = k
                    break
        if done is None:
            at = max(m.start() + 1, _RUN.match(plain, m.start()).end())
            continue
        start, at = m.start() + done[0], m.start() + done[1]
        if not _over(taken, start, at):
            found.append(Span(start, at, kind, done[2] if plain is text else _in_script(done[2], text[start:at])))
    return sorted(found, key=lambda s: s.start)


def _over(taken: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether one of the sorted disjoint stretches meets the one from ``start`` to ``end``."""
    i = bisect_left(taken, (end, 0))
    return i > 0 and taken[i - 1][1] > start


def pseudonymised(text: str, key: bytes, back: bool = False) -> tuple[str, list[Span]]:
    found = spans(text, key, back)
    if not found:
        return text, found
    out, at = [], 0
    for s in found:
        out += [text[at : s.start], s.new]
        at = s.end
    return "".join([*out, text[at:]]), found


def pseudonymise(df: DataFrame, key: bytes, text: str = "text", column: str = "pseudonymised") -> DataFrame:
    """All columns of ``df``, the text with pseudonyms (null for null), and how many of each kind it has."""
    keep, kept = beside(df, column, "found")

    def work():
        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            rows = [pseudonymised(t, key) for t in part.column(part.num_columns - 1).to_pylist()]
            was = part.column(keep.index(text)).is_null()
            new = pc.if_else(was, pa.scalar(None, pa.string()), pa.array([r[0] for r in rows], pa.string()))
            counts = [pa.array([sum(s.kind == k for s in r[1]) for r in rows], pa.int32()) for k in KINDS]
            return pa.RecordBatch.from_arrays([*part.columns[:-1], new, pa.StructArray.from_arrays(counts, KINDS)], [*keep, column, "found"])

        return step

    return map_texts(df, keep, text, work, f"{kept}`{column}` string, found struct<{','.join(f'{k}:int' for k in KINDS)}>")
