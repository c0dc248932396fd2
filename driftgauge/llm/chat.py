"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example of its own: all preceding turns are its context and only that
reply is trainable. Turns behind the last assistant turn, and conversations without any, give one more
example without a trainable part (``target`` null), so that no turn is lost from the output.

The template writes a turn as ``<s>[INST]role[/INST]text</s>``. Control strings inside a role or a text are
broken by a backslash behind their first character, and a backslash is doubled; both are undone by
dropping each escaping backslash, so formatting is reversible.

Defined results: a null text or role is empty; rows with a null conversation id form one conversation;
turns are ordered by (turn, role, text), null turns first, so repeated rows and ties give one result;
an empty table gives no example; columns not named are ignored.

A conversation is the unit of an example, so the turns of one conversation meet in one row; conversations
themselves are spread by their id.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    begin: str = "<s>[INST]"
    middle: str = "[/INST]"
    end: str = "</s>"
    #: Strings that must not stand unescaped in a role or text. No one of them may begin inside another.
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")

    def _pattern(self) -> str:
        quote = lambda s: re.sub(r"([^A-Za-z0-9_])", r"\\\1", s)
        return "|".join(f"(?<={quote(c[0])})(?={quote(c[1:])})" for c in self.controls)

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), self._pattern(), "\\\\")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, r"(?s)\\(.)", "$1")

    def turn(self, role: Column, text: Column) -> Column:
        return F.concat(F.lit(self.begin), self.escape(role), F.lit(self.middle), self.escape(text), F.lit(self.end))

    def parse(self, formatted: Column) -> Column:
        """The (role, text) turns of a formatted string."""
        whole = F.split(formatted, re.escape(self.end))
        turns = F.slice(whole, F.lit(1), F.size(whole) - 1)
        cut = lambda t: F.instr(t, self.middle)
        return F.transform(turns, lambda t: F.struct(
            self.unescape(F.substring(t, F.lit(len(self.begin) + 1), cut(t) - 1 - len(self.begin))).alias("role"),
            self.unescape(F.substring(t, cut(t) + len(self.middle), F.length(t))).alias("text"),
        ))


LLAMA = Template()


def prefix_target_examples(df: DataFrame, template: Template = LLAMA, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", target_role: str = "assistant") -> DataFrame:
    """One row per assistant turn: (conv_id, example, n_turns, target, formatted, loss_start, loss_length, is_last).

    ``formatted`` holds the context and the reply; code points ``loss_start`` (from 0) up to ``loss_start + loss_length``
    are the trainable ones. ``target`` is the reply's place among the turns, from 0. The longest example of a
    conversation, ``is_last``, holds all its turns.
    """
    row = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    grouped = df.groupBy(F.col(conv_id).alias("conv_id")).agg(F.sort_array(F.collect_list(row)).alias("turns"))
    formed = grouped.select(
        "conv_id",
        F.size("turns").alias("n_turns"),
        F.transform("turns", lambda t: template.turn(t.role, t.text)).alias("parts"),
        F.transform("turns", lambda t: F.length(template.escape(t.text))).alias("lengths"),
        F.filter(F.transform("turns", lambda t, i: F.when((t.role == target_role) | (i == F.size("turns") - 1), F.struct(i.alias("at"), (t.role == target_role).alias("trains")))), lambda x: x.isNotNull()).alias("targets"),
    )
    each = formed.select("conv_id", "n_turns", "parts", "lengths", F.posexplode("targets").alias("example", "goal"))
    formatted = F.array_join(F.slice("parts", F.lit(1), F.col("goal.at") + 1), "")
    length = F.element_at("lengths", F.col("goal.at") + 1)
    return each.select(
        "conv_id",
        "example",
        "n_turns",
        F.when(F.col("goal.trains"), F.col("goal.at")).alias("target"),
        formatted.alias("formatted"),
        F.when(F.col("goal.trains"), F.length(formatted) - len(template.end) - length).otherwise(0).alias("loss_start"),
        F.when(F.col("goal.trains"), length).otherwise(0).alias("loss_length"),
        (F.col("goal.at") == F.col("n_turns") - 1).alias("is_last"),
    )


def duckdb_sql(more: list[tuple[int, int, str, str]], template: Template = LLAMA, target_role: str = "assistant") -> str:
    """``read_back`` of ``conversations`` and some more rows, in DuckDB SQL that never forms an example."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def escaped(x: str) -> str:
        x = f"replace({x}, '\\', '\\\\')"
        for c in template.controls:
            x = f"replace({x}, {quote(c)}, {quote(c[0] + chr(92) + c[1:])})"
        return x

    rows = "".join(f" UNION ALL SELECT {c}, {t}, {quote(r)}, {quote(x)}" for c, t, r, x in more)
    around = len(template.begin) + len(template.middle) + len(template.end)
    return f"""
    WITH a AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations{rows}),
    b AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n, {around} + length({escaped("role")}) + length({escaped("text")}) AS size FROM a WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
    c AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY i) AS upto, role = {quote(target_role)} AS trains FROM b)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
      coalesce(sum(CASE WHEN trains THEN length(text) END), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(CASE WHEN trains THEN text END, '' ORDER BY i), '')) AS loss_sha256,
      sum(CASE WHEN trains OR i = n THEN upto END)::BIGINT AS formatted_chars FROM c GROUP BY conv_id
    """


def read_back(examples: DataFrame, template: Template = LLAMA) -> DataFrame:
    """Digests of each conversation as its examples hold it."""
    reply = template.unescape(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_length")))
    turns = F.when(F.col("is_last"), template.parse(F.col("formatted")))
    each = examples.select("conv_id", "example", F.when(F.col("target").isNotNull(), reply).alias("reply"), turns.alias("turns"), F.length("formatted").cast("long").alias("chars"))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    whole = (
        each.select("conv_id", "example", "reply", "chars", F.size("turns").alias("n"), F.sha2(joined, 256).alias("sha"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("example", "reply"))).alias("replies"), F.max(F.when(F.col("n") >= 0, F.col("n"))).cast("long").alias("n_turns"), F.max("sha").alias("turns_sha256"), F.sum("chars").alias("formatted_chars"))
    )
    loss = F.array_join(F.transform("replies", lambda r: r.reply), "")
    return whole.select("conv_id", "n_turns", "turns_sha256", F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
