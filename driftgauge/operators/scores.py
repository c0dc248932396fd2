"""Scored responses: accuracy, gaps, unparseable answers, modal options, option scores."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import items as I
from ..functions import numerals

DEGENERATE, UNPARSEABLE = 0.90, 0.15
#: How vocabularies show a blank, a line break and a word's beginning.
MARKS = "\u0120\u010a\u2581"


def accuracy(responses: DataFrame, *by: str, correct: str = "correct") -> DataFrame:
    return responses.groupBy(*by).agg(F.avg(F.col(correct).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n_items"))


def source_gap(values: DataFrame, value: str, source: str, model: str = "model", language: str = "language", gap: str = "gap") -> DataFrame:
    """value at the source language less value, per model; null for a model without the source."""
    at = values.where(F.col(language) == F.lit(source)).groupBy(model).agg(F.max(value).alias("__at"))
    return values.join(at, model, "left").withColumn(gap, F.col("__at") - F.col(value)).drop("__at")


def unparseable_rate(responses: DataFrame, *by: str, predicted: str = "predicted") -> DataFrame:
    return responses.groupBy(*by).agg(F.coalesce(F.avg((F.col(predicted) < 0).cast("double")), F.lit(0.0)).alias("unparseable"))


def mode_share(responses: DataFrame, *by: str, predicted: str = "predicted", mode: str | None = None) -> DataFrame:
    """The modal option's share of valid predictions; 1 without any; null for generative shards, where options mean nothing."""
    counts = responses.groupBy(*by, predicted).agg(F.count(F.lit(1)).alias("c"))
    valid = F.when(F.col(predicted) >= 0, F.col("c"))
    share = F.coalesce(F.max(valid) / F.sum(valid), F.lit(1.0))
    out = counts.groupBy(*by).agg(share.alias("mode_share"), F.coalesce(F.sum(valid), F.lit(0)).alias("n_valid"))
    return out.withColumn("mode_share", F.when(F.col(mode) != "generative", F.col("mode_share"))) if mode else out


def degenerate(share: Column) -> Column:
    """A cell that collapsed onto one option; null and NaN never count."""
    return F.coalesce(~F.isnan(share) & (share > DEGENERATE), F.lit(False))


def flags(metrics: DataFrame) -> DataFrame:
    return metrics.withColumn("flag_unparseable", F.coalesce(F.col("unparseable") > UNPARSEABLE, F.lit(False))).withColumn("flag_degenerate", degenerate(F.col("mode_share")))


def robust_mean(ok: Column, value: Column) -> Column:
    """Mean over the cells that are fine, over all if none is."""
    return F.coalesce(F.avg(F.when(ok, value)), F.avg(value))


def marked(predictions: DataFrame, gold: DataFrame, *key: str) -> DataFrame:
    """Predictions joined to the gold answer (``answer_index``) and marked."""
    return predictions.join(gold.select(*key, "answer_index"), list(key)).withColumn("correct", (F.col("predicted") == F.col("answer_index")).cast("tinyint"))


def marked_numbers(df: DataFrame, text: str, gold: str, tolerance: float = 1e-4) -> DataFrame:
    """predicted 1 for a numeric match, 0 for none, -1 if either side has no number."""
    hit = lambda pair: F.when(pair["got"].isNull() | pair["want"].isNull(), -1).otherwise(numerals.matches(pair["want"], pair["got"], tolerance).cast("int"))
    pair = F.struct(numerals.final_number(F.col(text)).alias("got"), numerals.final_number(F.col(gold)).alias("want"))
    predicted = F.element_at(F.transform(F.array(pair), hit), 1)  # each numeral is read once
    return df.withColumn("predicted", predicted.cast("smallint")).withColumn("correct", F.greatest("predicted", F.lit(0)).cast("tinyint"))


def first_best(scores: Column) -> Column:
    """The first place, from 0, of the greatest score; -1 if there is none above -infinity."""
    kept = F.transform(scores, lambda s: F.when(s.isNull() | F.isnan(s), F.lit(float("-inf"))).otherwise(s.cast("double")))
    best = F.array_max(kept)
    return F.when(F.coalesce(best > F.lit(float("-inf")), F.lit(False)), F.array_position(kept, best) - 1).otherwise(-1).cast("smallint")


def group_best(scores: Column, groups: list[list[int]]) -> Column:
    """The best score of each group of places: the surface forms of one letter."""
    return F.array(*[F.array_max(F.array(*[F.get(scores, F.lit(i)) for i in g])) for g in groups])


def continuation_mean(logprobs: Column, stem: Column | int) -> Column:
    """Mean log probability of the tokens behind the stem; -infinity without any."""
    stem = stem if isinstance(stem, Column) else F.lit(stem)
    rest = F.slice(logprobs, stem + 1, F.greatest(F.size(logprobs) - stem, F.lit(0)))
    return F.when(F.size(rest) > 0, F.aggregate(rest, F.lit(0.0), lambda t, x: t + x.cast("double")) / F.size(rest)).otherwise(F.lit(float("-inf")))


def option_rows(items: DataFrame) -> DataFrame:
    """(item_id, language, option, stem, prompt): one row per item and option for continuation scoring."""
    stem = F.concat(I.without_last_line(F.col("prompt")), F.lit(I.ANSWER_CUE))
    rows = items.select("item_id", "language", stem.alias("stem"), F.posexplode("options").alias("option", "text"))
    return rows.select("item_id", "language", "option", "stem", F.concat("stem", F.lit(" "), "text").alias("prompt"))


def letter_tokens(vocabulary: DataFrame, n_options: int) -> DataFrame:
    """(option, letter, ids) of a ``vocabulary`` (id, token as it is shown): the tokens that are the option's letter once blanks and word marks before it are taken off.

    Raises if an option has none. ``ids`` are in order; as lists by option they are the places for ``group_best``.
    """
    if not 0 < n_options <= len(I.LETTERS):
        raise ValueError(f"between 1 and {len(I.LETTERS)} options")
    bare = F.regexp_replace("token", f"^[\\s{MARKS}]+", "")
    letters = vocabulary.sparkSession.createDataFrame(list(enumerate(I.LETTERS[:n_options])), "option int, letter string")
    held = vocabulary.select("id", bare.alias("letter")).where(F.length("letter") == 1).groupBy("letter").agg(F.array_sort(F.collect_set("id")).alias("ids"))  # a vocabulary is a dimension
    found = letters.join(held, "letter", "left").select("option", "letter", F.coalesce("ids", F.array().cast(held.schema["ids"].dataType)).alias("ids"))
    if gone := [r.letter for r in found.where(F.size("ids") == 0).select("letter").collect()]:
        raise ValueError(f"the vocabulary has no token for {', '.join(sorted(gone))}")
    return found


class Scorer(Protocol):
    """Made once per worker and call of ``scored``; gets a pandas frame of items with prompts and returns their score columns."""

    def __call__(self, rows: pd.DataFrame) -> pd.DataFrame: ...


#: The scorer of this worker process, by the call that it belongs to: one at a time, as engines are large.
_engine: dict[str, Scorer] = {}


def _engine_of(call: str, make: Callable[[], Scorer]) -> Scorer:
    if call not in _engine:
        _engine.clear()
        _engine[call] = make()
    return _engine[call]


def batches(frame: pd.DataFrame, lengths: pd.Series, most_chars: int, most_rows: int) -> Iterator[pd.DataFrame]:
    """Consecutive parts of ``frame`` of at most ``most_rows`` rows whose longest prompt times their number is at most ``most_chars``: what padding makes of a batch. A longer prompt is a batch alone."""
    start, longest = 0, 0
    for i, n in enumerate(lengths):
        longest = max(longest, int(n))
        if i > start and (longest * (i + 1 - start) > most_chars or i - start >= most_rows):
            yield frame.iloc[start:i]
            start, longest = i, int(n)
    if start < len(frame):
        yield frame.iloc[start:]


def scored(items: DataFrame, make: Callable[[], Scorer], schema: str, mode: str = "letter", prompt: str = "prompt", most_chars: int = 1 << 18, most_rows: int = 256, profile: ResourceProfile | None = None) -> DataFrame:
    """Items through an injected scorer. Items with fewer than two options are refused unless generative.

    A worker process makes its scorer once and keeps it from task to task. Prompts are ordered by length within a partition, so that those of a batch (``batches``) are about
    equally long; a null prompt is empty. ``profile`` asks for the stage's own resources (accelerators, memory), where the cluster schedules by them.
    """
    if mode not in ("letter", "loglik", "generative"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode != "generative":
        items = items.withColumn("options", F.when(F.size("options") >= 2, F.col("options")).otherwise(F.raise_error(F.lit("an item has fewer than two options")).cast("array<string>")))
    call = uuid.uuid4().hex

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = _engine_of(call, make)
        for frame in frames:
            for part in batches(frame, frame[prompt].fillna("").str.len(), most_chars, most_rows):
                yield scorer(part)

    return items.sortWithinPartitions(F.desc(F.length(F.coalesce(prompt, F.lit(""))))).mapInPandas(run, schema, profile=profile)


def token_counts(df: DataFrame, make: Callable[[], Callable[[str], int]], text: str = "text", name: str = "n_tokens") -> DataFrame:
    """``df`` with how many tokens ``text`` has by an injected tokenizer, which each task makes once; a null text has none."""

    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        n = make()
        for t in texts:
            yield t.map(lambda x: 0 if x is None else n(x)).astype("int64")

    return df.withColumn(name, count(F.col(text)))


def length_ratio(docs: DataFrame, base: str, lang: str = "lang", length: str = "n_chars") -> DataFrame:
    """(lang, mean_length, ratio): mean length by language against a base language; ``length`` is any column of lengths, characters or tokens."""
    means = docs.groupBy(lang).agg(F.avg(length).alias("mean_length"))
    return means.withColumn("ratio", F.try_divide("mean_length", F.max(F.when(F.col(lang) == base, F.col("mean_length"))).over(Window.partitionBy())))
