"""Threshold-scaled document sketches, with DataFrame functions only.

A text's sketch keeps every hash of its word shingles that lies below a fixed fraction of the hash space. The fraction
is the same for every text, so sketches of very unequal texts compare directly, and the sketch of two texts together
is the union of their sketches. Containment of one text in another is the share of its kept hashes that the other
keeps; likeness is the containment of the text with the smaller sketch in the other.

A text with words none of whose hashes lies below the fraction has an empty sketch but, marked apart, its least hash:
struct<kept, least>, ``least`` null unless ``kept`` is empty. Merging holds for both parts: the merged sketch is that of all
shingles of both texts, whatever their lengths. Such a text is only ever likened by its least hash: contained (1) in
a text that has the same least hash apart, else not (0).

Defined results: words are cut at white space (blank and code points 9 to 13) and A-Z lower-cased; a text of fewer words than a shingle is one
shingle; a text without words has neither part. Two such have likeness 1, one of them and another text 0. A null text is empty; texts are
sketched whole; ids may be null or repeat (``with_next`` then orders them by the rest); an empty table gives an empty one. For ``with_next`` the names ``__range``, ``__end`` and ``next_`` before a carried column's must be free.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import text_or_empty

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, UPPER, LOWER), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def sketch(text: Column, k: int = 3, one_in: int = 16) -> Column:
    """struct<kept: array<bigint>, least: bigint>: the sorted distinct hashes of a text's shingles of ``k`` words of which one in ``one_in`` is kept, or the least hash where none is."""
    # one lambda variable holds the words, so that they are cut once
    def hashes(w: Column) -> Column:
        n = F.size(w)
        every = F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i: F.xxhash64(*[F.try_element_at(w, i + j) for j in range(k)]))
        return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(every)

    def parts(h: Column) -> Column:
        below = F.array_sort(F.array_distinct(F.filter(h, lambda x: F.shiftrightunsigned(x, 1) < F.lit((1 << 63) // one_in))))
        return F.transform(F.array(below), lambda b: F.struct(b.alias("kept"), F.when(F.size(b) == 0, F.array_min(h)).alias("least")))

    return F.element_at(F.flatten(F.transform(F.transform(F.array(words(text)), hashes), parts)), 1)


def hexed(sketched: Column) -> Column:
    """A sketch as a string: 16 digits a hash; a least hash behind a tilde."""
    digits = lambda h: F.lpad(F.hex(h), 16, "0")
    return F.concat(F.array_join(F.transform(sketched["kept"], digits), ""), F.coalesce(F.concat(F.lit("~"), digits(sketched["least"])), F.lit("")))


def merged(a: Column, b: Column) -> Column:
    """The sketch of all shingles of both texts."""
    kept = F.array_sort(F.array_union(a["kept"], b["kept"]))
    return F.struct(kept.alias("kept"), F.when(F.size(kept) == 0, F.least(a["least"], b["least"])).alias("least"))


def containment(a: Column, b: Column) -> Column:
    """The share of ``a`` that is in ``b``."""
    share = F.size(F.array_intersect(a["kept"], b["kept"])) / F.size(a["kept"])
    return F.when(F.size(a["kept"]) > 0, share).when(a["least"].isNull(), F.lit(1.0)).otherwise(F.coalesce((a["least"] == b["least"]).cast("double"), F.lit(0.0)))


def likeness(a: Column, b: Column) -> Column:
    smaller = F.least(F.size(a["kept"]), F.size(b["kept"]))
    shared = F.size(F.array_intersect(a["kept"], b["kept"])) / smaller
    return F.when(smaller > 0, shared).when((F.size(a["kept"]) == 0) & (F.size(b["kept"]) == 0), a["least"].eqNullSafe(b["least"]).cast("double")).otherwise(F.lit(0.0))


def fingerprints(df: DataFrame, text: str = "text", column: str = "sketch", k: int = 3, one_in: int = 16) -> DataFrame:
    """All columns of ``df``, then the sketch of the text."""
    return df.withColumn(column, sketch(text_or_empty(text), k, one_in))


MOST_RANGES = 1 << 17


def _cuts(keys: DataFrame, rows_each: int) -> list[int]:
    """Every ``rows_each``-th distinct key or so, in order, but for the first: at most ``MOST_RANGES``, whatever the table's size."""
    n = keys.count()
    step = max(rows_each, -(-n // MOST_RANGES))
    if n <= step:
        return []
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # adaptive execution must not join the partitions anew: a number is given
    placed = keys.repartitionByRange(parts, "key").withColumn("part", F.spark_partition_id()).groupBy("part", "key").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy("part").orderBy("key"))
    ranked = placed.withColumn("upto", upto)
    marked = ranked.where(F.floor((F.col("upto") - 1) / step) > F.floor((F.col("upto") - F.col("c") - 1) / step))  # holds a row whose rank is a multiple of step
    return sorted({r.key for r in marked.select("key").collect()} - {ranked.agg(F.min("key")).first()[0]})


def with_next(df: DataFrame, order: list[str], carried: list[str], rows_each: int = 1000, prepared: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """Each row of ``df`` and, as ``next_<name>``, the carried columns of the row behind it in ascending order; behind the last comes the first.

    The order's first column must be a whole number. Rows are cut into ranges of about ``rows_each`` rows (at most 131,072 ranges) by the ranks of that
    column alone, which are counted in range partitions; each range is ordered by itself and ends with a copy of the first row of the
    next one. Rows that are equal in the first column share a range. ``prepared`` adds columns to each row before the ranges are formed, and only
    then, not in the passes that find them.
    """
    first = order[0]
    found = _cuts(df.select(F.col(first).cast("long").alias("key")).where("key IS NOT NULL"), rows_each)
    side = max(1, int(len(found) ** 0.5))
    groups = [found[i : i + side] for i in range(0, len(found), side)]
    if groups:
        of = F.col(first)
        # literals of one string each, which are parsed once
        heads = F.from_json(F.lit(json.dumps([g[0] for g in groups])), "array<bigint>")
        table = F.from_json(F.lit(json.dumps(groups)), "array<array<bigint>>")
        g = F.size(F.filter(heads, lambda x: x <= of))
        within = F.size(F.filter(F.get(table, g - 1), lambda x: x <= of))
        place = F.when(of.isNull() | (g == 0), F.lit(0)).otherwise((g - 1) * side + within)
    else:
        place = F.lit(0)
    cut = df.withColumn("__range", place.cast("int"))
    firsts = cut.groupBy("__range").agg(F.min_by(F.struct(*[F.col(c) for c in df.columns]), F.struct(*[F.col(c) for c in order])).alias("r"))
    # one row per range: which range comes before which
    ids = cut.select("__range").distinct()
    one = Window.orderBy("__range")
    before = ids.select(F.col("__range").alias("__of"), F.coalesce(F.lag("__range").over(one), F.max("__range").over(Window.partitionBy())).alias("__before"))
    ends = firsts.join(before, F.col("__range") == F.col("__of")).select("r.*", F.col("__before").alias("__range"), F.lit(1).alias("__end"))
    every = prepared(cut.withColumn("__end", F.lit(0)).unionByName(ends))
    w = Window.partitionBy("__range").orderBy("__end", *order)
    return every.withColumns({f"next_{c}": F.lead(c).over(w) for c in carried}).where("__end = 0").drop("__range", "__end")
