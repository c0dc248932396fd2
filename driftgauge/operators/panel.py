"""Item sets and crossed panels: selection, coverage, completeness, alignment. All joins are equi-joins on ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, few

#: Shares beyond which a benchmark is refused.
MAX_UNSHARED, MAX_MALFORMED = 0.01, 0.02
_WORD = 62


def shared_ids(ids: DataFrame, item: str = "item_id", lang: str = "lang") -> DataFrame:
    """The items that every language has: one shuffle by item, whatever the number of languages."""
    langs = ids.agg(F.count_distinct(lang).alias("__n"))
    per = ids.groupBy(item).agg(F.count_distinct(lang).alias("__c"))
    return per.join(F.broadcast(langs), F.col("__c") == F.col("__n")).select(item)


def coverage(ids: DataFrame, shared: DataFrame, item: str = "item_id", lang: str = "lang") -> DataFrame:
    """(lang, n_total, n_unshared): rows of each language, and its distinct items that others lack."""
    marked = ids.join(shared.withColumn("__in", F.lit(True)), item, "left")
    return marked.groupBy(lang).agg(F.count(F.lit(1)).alias("n_total"), F.count_distinct(F.when(F.col("__in").isNull(), F.col(item))).alias("n_unshared"))


def language_sets(ids: DataFrame, item: str = "item_id", lang: str = "lang") -> DataFrame:
    """(item, languages): each item's languages, with its rows in each, from one pass over ``ids``; what sets of items share or lack follows from it. Rows without item or language don't count."""
    cells = ids.where(F.col(item).isNotNull() & F.col(lang).isNotNull()).groupBy(item, lang).agg(F.count(F.lit(1)).alias("n"))
    return cut(cells.groupBy(item).agg(F.collect_list(F.struct(F.col(lang).alias("lang"), "n")).alias("languages")))  # languages are a small dimension


def _all_of(sets: DataFrame) -> DataFrame:
    """``sets`` with ``full``: whether the item has every language that occurs."""
    langs = sets.select(F.explode("languages.lang").alias("lang")).agg(F.count_distinct("lang").alias("__n"))
    return sets.crossJoin(F.broadcast(langs)).withColumn("full", F.size("languages") == F.col("__n")).drop("__n")  # one row


def shared_of(sets: DataFrame) -> DataFrame:
    """The items of ``language_sets`` that every language has."""
    return _all_of(sets).where("full").drop("languages", "full")


def coverage_of(sets: DataFrame, lang: str = "lang") -> DataFrame:
    """(lang, n_total, n_unshared) of ``language_sets``, as ``coverage`` has it."""
    cells = _all_of(sets).select("full", F.explode("languages").alias("l"))
    return cells.groupBy(F.col("l.lang").alias(lang)).agg(F.sum("l.n").alias("n_total"), F.count_if(~F.col("full")).alias("n_unshared"))


def check_parallel(covered: DataFrame, most: float = MAX_UNSHARED, lang: str = "lang") -> None:
    """Refuses a benchmark whose language versions aren't the same test."""
    bad = covered.where(F.col("n_unshared") > F.col("n_total") * most).orderBy(lang).limit(20).collect()
    if bad:
        raise ValueError("not parallel: " + ", ".join(f"{r[lang]} ({r.n_unshared} of {r.n_total})" for r in bad))


def capped(shared: DataFrame, cap: int | None, seed: int, item: str = "item_id") -> DataFrame:
    """The first ``cap`` items in the order of SHA-256(seed:id), so that smaller caps are subsets of larger ones. None takes all."""
    if cap is None:
        return shared
    return shared.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(item)), 256), item).limit(cap)


def select_items(ids: DataFrame, cap: int | None, seed: int, item: str = "item_id", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(selected ids, coverage); raises if no item is shared by all languages."""
    sets = language_sets(ids, item, lang)
    shared = shared_of(sets)
    if shared.isEmpty():
        raise ValueError("the languages share no item")
    return capped(shared, cap, seed, item), coverage_of(sets, lang)


def malformed_ids(items: DataFrame, bad: str = "malformed", item: str = "item_id") -> DataFrame:
    """Items that are malformed in any language."""
    return items.where(F.col(bad)).select(item).distinct()


def drop_malformed(items: DataFrame, bad: str = "malformed", item: str = "item_id", lang: str = "lang", most: float = MAX_MALFORMED) -> DataFrame:
    """Drops malformed items from every language; raises if they are more than ``most`` of the largest language."""
    ids = malformed_ids(items, bad, item)
    rows = items.groupBy(lang).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n"))
    n, largest = ids.agg(F.count(F.lit(1)).alias("c")).crossJoin(rows).first()
    if n > most * (largest or 0):
        raise ValueError(f"{n} malformed items of {largest}")
    return items.join(ids, item, "left_anti")


def last_rows(items: DataFrame, order: str, item: str = "item_id", lang: str = "lang") -> DataFrame:
    """One row per language and item; of repeated ids the last by ``order``."""
    rest = [c for c in items.columns if c not in (item, lang)]
    return items.groupBy(lang, item).agg(F.max_by(F.struct(*rest), order).alias("r")).select(lang, item, "r.*")


def missing_cells(seen: DataFrame, *axes: str) -> DataFrame:
    """Combinations of the axes' values that don't occur. Only combinations of the first axes (small dimensions) that lack a value of the
    last one are expanded, so a complete design costs two aggregations."""
    cells = seen.select(*axes).distinct()
    *first, last = axes
    values = seen.select(last).distinct()
    if not first:
        return values.limit(0)
    design = seen.select(first[0]).distinct()
    for a in first[1:]:
        design = design.crossJoin(seen.select(a).distinct())
    held = cells.groupBy(*first).agg(F.count(F.lit(1)).alias("__held"))
    short = design.join(held, first, "left").crossJoin(F.broadcast(values.agg(F.count(F.lit(1)).alias("__all")))).where(F.coalesce("__held", F.lit(0)) < F.col("__all")).select(*first)
    return short.crossJoin(values).join(cells, list(axes), "left_anti")


def require_source(cells: DataFrame, source: str | int, language: str = "language") -> None:
    """Raises unless the source language occurs: without it nothing says where drift is 0."""
    if cells.where(F.col(language) == F.lit(source)).isEmpty():
        raise ValueError(f"the source language {source!r} isn't there")


def require_complete(cells: DataFrame, *axes: str) -> None:
    """Raises if a combination of the axes' values is missing."""
    gone = missing_cells(cells, *axes)
    if some := gone.limit(5).collect():
        raise ValueError("the panel isn't crossed: without " + "; ".join(", ".join(f"{a} {r[a]}" for a in axes) for r in some))


def set_differences(shards: DataFrame, reference: DataFrame, item: str = "item_id", by: tuple[str, ...] = ("model", "language")) -> DataFrame:
    """(by, extra, missing): how each shard's item set differs from the reference's (item)."""
    ref = reference.select(item).distinct()
    have = shards.select(*by, item).distinct().join(ref.withColumn("__ref", F.lit(1)), item, "left")
    sums = have.groupBy(*by).agg(F.sum(F.when(F.col("__ref").isNull(), 1).otherwise(0)).alias("extra"), F.sum(F.coalesce("__ref", F.lit(0))).alias("__hit"))
    return sums.crossJoin(F.broadcast(ref.agg(F.count(F.lit(1)).alias("__n")))).select(*by, "extra", (F.col("__n") - F.col("__hit")).alias("missing"))


def same_sets(cells: DataFrame, shards: DataFrame, item: str = "item_id", by: tuple[str, ...] = ("model", "language")) -> bool:
    """Whether every one of ``shards`` (by, each once; a small dimension) has all items that occur in ``cells``.

    An item's shards are bits of a few numbers, set where its cells are: neither are cells made distinct nor are items met with a reference.
    """
    n = shards.count()
    words = range(n // _WORD + 1)
    at = shards.select(*[F.col(c).alias(f"__{c}") for c in by], (F.row_number().over(Window.orderBy(*by)) - 1).alias("__at"))
    bits = [F.expr(f"CASE WHEN __at DIV {_WORD} = {j} THEN shiftleft(1L, __at % {_WORD}) ELSE 0L END").alias(f"__bit{j}") for j in words]
    numbered = few(cut(at.select(*[f"__{c}" for c in by], *bits)))
    here = F.lit(True)
    for c in by:
        here &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    held = cells.select(*by, item).join(numbered, here).groupBy(item).agg(*[F.bit_or(f"__bit{j}").alias(f"__seen{j}") for j in words])
    return held.where(reduce(Column.__add__, [F.bit_count(f"__seen{j}") for j in words]) < n).isEmpty()


def duplicates(cells: DataFrame, *key: str) -> DataFrame:
    return cells.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def common_panel(a: DataFrame, b: DataFrame, *axes: str, least: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Both panels on the axis values that they share; raises if an axis shares fewer than ``least`` of it.

    Each panel is passed over once for its combinations of axis values, among which the shared ones are found.
    """
    held_a, held_b = (cut(d.select(*axes).distinct()) for d in (a, b))
    for axis in axes:
        both = few(cut(held_a.select(axis).distinct().intersect(held_b.select(axis).distinct())))
        if least and both.limit(least.get(axis, 0)).count() < least.get(axis, 0):
            raise ValueError(f"the panels share too few values of {axis}")
        a, b, held_a, held_b = (d.join(both, axis, "left_semi") for d in (a, b, held_a, held_b))
    return a, b


def grid_slice(grid: DataFrame, order: list[str], index: int, of: int) -> DataFrame:
    """Every ``of``-th row of an ordered grid (a small dimension), from ``index`` on."""
    at = F.row_number().over(Window.orderBy(*order)) - 1
    return grid.withColumn("__at", at).where(F.col("__at") % of == index).drop("__at")


def outstanding(wanted: DataFrame, done: DataFrame, *key: str) -> DataFrame:
    """What is still to be made: resuming is an anti-join on the catalogue of what exists."""
    return wanted.join(done.select(*key).distinct(), list(key), "left_anti")
