"""Free-form numerals of any script as columns.

The final numeral of a text is the last one behind the last occurrence of the first cue word that has a numeral behind
it, else the last of the text. Null means that there is none, which differs from 0.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words for "answer", in the order in which they are tried.
CUES = ("answer", "réponse", "respuesta", "antwort", "risposta", "resposta", "ответ", "答案", "答え", "คำตอบ", "jibu", "উত্তর", "సమాధానం")
#: Fixed value: a numeral, with blanks of any script between its digits.
NUMERAL = r"(?U)[-+]?[0-9][0-9\s.,  ]*"
_ANY_SPACE = "[\\s\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\u0085\\u001C-\\u001F]"


@cache
def _digits() -> tuple[str, str]:
    """Every character that Unicode gives a digit value, and the ASCII digits."""
    found = [(chr(i), str(unicodedata.digit(chr(i)))) for i in range(128, sys.maxunicode + 1) if chr(i).isdigit() and unicodedata.digit(chr(i), None) is not None]
    return "".join(c for c, _ in found), "".join(d for _, d in found)


def ascii_digits(text: Column) -> Column:
    """Digits of any script as ASCII digits; one character for one."""
    any_script, plain = _digits()
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(F.translate(text, any_script, plain))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _count(raw: Column, what: str) -> Column:
    return F.length(raw) - F.length(F.replace(raw, F.lit(what), F.lit("")))


def _without(raw: Column, what: str) -> Column:
    return F.replace(raw, F.lit(what), F.lit(""))


def resolve_separators(raw: Column) -> Column:
    """One reading of points and commas: what repeats groups thousands; of one each the later is the decimal mark; a single one groups if three digits follow."""
    dots, commas = _count(raw, "."), _count(raw, ",")
    pointed = F.replace(_without(raw, "."), F.lit(","), F.lit("."))
    behind = F.length(F.regexp_extract(raw, r"[.,]([^.,]*)$", 1))
    last_is_dot = F.instr(F.reverse(raw), ".") < F.instr(F.reverse(raw), ",")
    return (
        F.when((dots == 0) & (commas == 0), raw)
        .when(dots > 1, pointed)
        .when(commas > 1, _without(raw, ","))
        .when((dots == 1) & (commas == 1), F.when(last_is_dot, _without(raw, ",")).otherwise(pointed))
        .when(behind == 3, _without(_without(raw, "."), ","))
        .otherwise(F.replace(raw, F.lit(","), F.lit(".")))
    )


def to_double(raw: Column) -> Column:
    """A matched numeral's value; blanks other than space, U+00A0 and U+202F inside it leave none."""
    bare = F.regexp_replace(F.regexp_replace(raw, f"^{_ANY_SPACE}+|{_ANY_SPACE}+$", ""), "[ \\u00A0\\u202F]", "")
    bare = F.regexp_replace(bare, "[.,]+$", "")
    number = lambda plain: F.when(plain.rlike(r"^[-+]?[0-9]*\.?[0-9]+$|^[-+]?[0-9]+\.$"), plain.try_cast("double"))
    return _let(bare, lambda b: _let(resolve_separators(b), number))


def final_number(text: Column) -> Column:
    """The final numeral of a text as double, or null."""
    def tail(source: Column, folded: Column, cue: str) -> Column:
        at = F.length(folded) - F.instr(F.reverse(folded), cue[::-1]) - len(cue) + 2
        rest = F.substring(source, at, F.length(source))
        return F.when((F.instr(folded, cue) > 0) & rest.rlike("[0-9]"), rest)

    def answer(plain: Column, folded: Column) -> Column:
        same = F.length(folded) == F.length(plain)  # folding may change the length; places are then taken in the folded text
        source = F.when(same, plain).otherwise(folded)
        return F.coalesce(F.when(folded.rlike("|".join(CUES)), F.coalesce(*[tail(source, folded, c) for c in CUES])), plain)

    last = lambda t: F.try_element_at(F.regexp_extract_all(t, F.lit(NUMERAL), F.lit(0)), F.lit(-1))
    return _let(ascii_digits(text), lambda plain: _let(F.lower(plain), lambda folded: _let(last(answer(plain, folded)), to_double)))


def matches(gold: Column, got: Column, tolerance: float = 1e-4) -> Column:
    """Whether a number agrees with the expected one, relative to the latter's size from 1 on."""
    return F.abs(got - gold) <= tolerance * F.greatest(F.lit(1.0), F.abs(gold))
