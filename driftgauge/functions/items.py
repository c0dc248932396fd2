"""Benchmark rows to items: ids, options, answers and prompts as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The joint of composite ids, option letters, and the wording that prompts must have.
JOINT = "␟"
LETTERS = "ABCDEFGHIJ"
NLI_OPTIONS = ("True", "Neither", "False")
CAUSAL = {"cause": "What was the cause of this?", "effect": "What happened as a result?"}
ANSWER_CUE = "\nAnswer:"
THINK = "\n\nThink step by step, then give the final numeric answer.\nAnswer:"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def item_id(fields: str | Sequence[str], position: Column | None = None) -> Column:
    """A column's value, several joined by U+241F, or, for ``__row_index__``, a position from 0 that the caller has ordered."""
    if fields == "__row_index__":
        if position is None:
            raise ValueError("a row index needs an explicit position")
        return position.cast("string")
    names = [fields] if isinstance(fields, str) else list(fields)
    parts = [F.coalesce(F.col(n).cast("string"), F.lit("None")) for n in names]
    return parts[0] if len(parts) == 1 else F.concat_ws(JOINT, *parts)


def _blank(o: Column) -> Column:
    return o.isNull() | (F.regexp_replace(o, r"(?U)\s+", "") == "")


def stripped_options(options: Column) -> Column:
    """Options without the blank ones at the end."""
    filled = F.filter(F.transform(options, lambda o, i: F.when(~_blank(o), i + 1).otherwise(0)), lambda i: i > 0)
    return F.slice(options, F.lit(1), F.coalesce(F.array_max(filled), F.lit(0)))


def has_hole(options: Column) -> Column:
    """Whether a blank option stands before a filled one: dropping it would shift the answer."""
    return F.exists(stripped_options(options), _blank)


def options_of(fields: dict) -> Column:
    """By mapping: a list column, several columns, or the fixed triple of inference tasks."""
    given = fields.get("options")
    if isinstance(given, str):
        return F.transform(F.col(given), lambda o: o.cast("string"))
    if given:
        return F.array(*[F.col(c).cast("string") for c in given])
    if "hypothesis" in fields:
        return F.array(*[F.lit(o) for o in NLI_OPTIONS])
    raise ValueError(f"no options in {fields!r}")


def question_of(fields: dict) -> tuple[Column, Column]:
    """(question, context) by mapping; the context may be null."""
    none = F.lit(None).cast("string")
    if "hypothesis" in fields:
        stem = F.concat(_text(fields["premise"]), F.lit("\nQuestion: "), _text(fields["hypothesis"]), F.lit(" True, False, or Neither?"))
        return stem, none
    context = fields.get("context")
    around = F.concat_ws(" ", *[_text(c) for c in context]) if isinstance(context, (list, tuple)) else _text(context) if context else none
    question = _text(fields["question"]) if "question" in fields else F.lit("")
    if "premise" in fields:
        around = _text(fields["premise"])
        asked = F.create_map(*[F.lit(x) for kv in CAUSAL.items() for x in kv])
        question = F.coalesce(F.try_element_at(asked, F.lower(F.trim(question))), question)
    return question, around


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("None"))


def answer_index(raw: Column, base: int | None, n_options: Column, strict: bool = False) -> Column:
    """The 0-based place of the answer. One letter A-J counts by itself; numbers need a declared base of 0 or 1.

    What can't be read or is out of range gives null, or an error if ``strict``.
    """
    if base not in (None, 0, 1):
        raise ValueError(f"the answer base must be 0 or 1, not {base!r}")
    s = F.upper(F.trim(raw.cast("string")))
    letter = F.when(F.length(s) == 1, F.instr(F.lit(LETTERS), s) - 1)
    number = F.trim(raw.cast("string")).try_cast("int") - F.lit(base) if base is not None else F.lit(None).cast("int")
    index = F.when(letter >= 0, letter).otherwise(number)
    index = F.when((index >= 0) & (index < n_options), index)
    return F.coalesce(index, F.raise_error(F.concat(F.lit("no valid answer: "), raw.cast("string"))).cast("int")) if strict else index


def choice_prompt(question: Column, options: Column, context: Column) -> Column:
    """Context, question, lettered options and the instruction to answer by letter."""
    lettered = F.array_join(F.transform(options, lambda o, i: F.concat(F.substring(F.lit(LETTERS), i + 1, F.lit(1)), F.lit(". "), o)), "\n")
    head = F.when(F.coalesce(context, F.lit("")) != "", F.concat(F.trim(context), F.lit("\n\n"))).otherwise("")
    last = F.substring(F.lit(LETTERS), F.size(options), F.lit(1))
    return F.concat(head, F.trim(question), F.lit("\n"), lettered, F.lit("\nAnswer with a single letter from A to "), last, F.lit("." + ANSWER_CUE))


def generative_prompt(prompt: Column) -> Column:
    return F.concat(F.trim(prompt), F.lit(THINK))


def without_last_line(prompt: Column) -> Column:
    return F.regexp_replace(prompt, r"\n[^\n]*\z", "")
