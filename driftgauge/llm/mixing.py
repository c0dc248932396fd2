"""Mixing sources to target weights by capped water-filling.

The mix has a budget of words. Each source gets it in proportion to its weight, but no more than its maximum epochs
allow; what is above a cap is shared anew by weight until no target is above. In closed form: sources fill in the order
of cap / weight, and those that the common level doesn't reach are clamped. Within a source every document is taken
floor(target / size) times whole, and the remaining words come from a seeded sample of whole documents, in the order of
their seeded hash: first long ones (over 1/8 of the remaining words) up to their share of the words, then the others
until the remaining words are there, each time to the document that comes nearest. Hashes fall into equal bins, 1,024 or
one to every 1,000 rows (1,048,576 at most); only the bins' sums and the documents of the bin in which the count is reached are
ever ordered, so no source meets in one task. What is taken follows from two cuts per source in that order, so a row's repeats don't depend on others.

Defined results: a null text has size 0; documents without words are taken 0 times; a null source is a source of its
own, ordered last; sources of size 0 or weight 0 have target 0; if all caps together are below the budget, each source
gets its cap; repeated rows count as documents of their own; reruns and other partitionings agree. Only a text's words are counted, whatever its
length; an empty table gives an empty one. Up to 10,000 sources their targets are broadcast; beyond, rows meet them by shuffling on the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import checkpointed, small_side

#: Fixed value: a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Powers of two: the least and the most bins of hashes; between them one bin to every ``IN_BIN`` rows.
BINS, IN_BIN = (10, 20), 1_000
LONG = 8
#: Hashes are whole numbers below this power of two: the first 15 digits of an MD5 digest.
HASH_BITS = 60


def bin_power(rows: int) -> int:
    return min(max(BINS[0], (rows // IN_BIN).bit_length()), BINS[1])


def n_words(text: str | Column) -> Column:
    """Words of a text (0 for null): the places where a word begins."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: list[float], budget: float, max_epochs: float) -> DataFrame:
    """(source, source_size, target) from one row per source (source, source_size); weights repeat by code point order, null last."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.array(*[F.lit(float(w)) for w in weights])
    s = (
        sizes.withColumn("w", F.get(pick, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))))
        .withColumn("cap", F.when(F.col("w") > 0, F.col("source_size") * F.lit(float(max_epochs))).otherwise(0.0))
        .withColumn("total", F.sum("source_size").over(Window.partitionBy()) * F.lit(float(budget)))
    )
    fill = Window.orderBy(F.try_divide("cap", "w").asc_nulls_first(), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = F.try_divide(F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.sum("w").over(onward))
    s = s.withColumn("level", level).withColumn("nth", F.row_number().over(fill)).withColumn("clamped", F.coalesce(F.col("cap") <= F.col("level") * F.col("w"), F.lit(True)))
    # the sources behind the first that isn't clamped, in the order of filling also among ties, share its level
    first = F.min(F.when(~F.col("clamped"), F.struct("nth", "level"))).over(Window.partitionBy())["level"]
    return s.withColumn("target", F.when(first.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), first * F.col("w")))).select("source", "source_size", "target")


def _cuts(keys: DataFrame, rest: DataFrame, name: str) -> DataFrame:
    """(of, <name>): per source the bin in which ``rest`` words (of, rest) are reached in hash order, and the last key in it that is taken, if any."""
    bins = keys.groupBy("source", "bin").agg(F.sum("words").alias("words")).join(rest, F.col("source").eqNullSafe(F.col("of")))
    run = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # a row to a bin
    bins = bins.withColumn("ahead", F.coalesce(F.sum("words").over(run), F.lit(0))).where("ahead < rest")
    edge = bins.groupBy("of").agg(F.max(F.struct("bin", "ahead", "rest")).alias("e")).select("of", F.col("e.bin").alias("edge"), "e.ahead", "e.rest")
    inside = keys.join(edge, F.col("source").eqNullSafe(F.col("of")) & (F.col("bin") == F.col("edge")))
    order = Window.partitionBy("source", "bin").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("ahead") + F.coalesce(F.sum("words").over(order), F.lit(0)) + F.col("words") / 2
    taken = F.when(at < F.col("rest"), F.struct("h", "doc_id", "size"))
    return inside.withColumn("taken", taken).groupBy(F.col("source").alias("of"), "edge").agg(F.max("taken").alias("last")).select("of", F.struct("edge", "last").alias(name))


def _within(cut: str) -> Column:
    key = F.struct("h", "doc_id", "size")
    return F.coalesce((F.col("bin") < F.col(f"{cut}.edge")) | ((F.col("bin") == F.col(f"{cut}.edge")) & (key <= F.col(f"{cut}.last"))), F.lit(False))


def mix(df: DataFrame, weights: list[float], budget: float = 1.0, max_epochs: float = 2.0, seed: int = 0, doc_id: str = "doc_id", source: str = "source", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, repeats, taken, kept columns) of every row of ``df``; ``budget`` is a multiple of all words."""
    keep = keep or []
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(text).alias("size"), *[F.col(c).alias(f"kept_{c}") for c in keep])
    small = checkpointed(rows.select("doc_id", "source", "size"))  # ids and sizes, read several times; texts pass once more only if they are kept

    power = bin_power(small.count())

    def hashed(x: DataFrame) -> DataFrame:
        named = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
        h = F.conv(F.substring(F.md5(named), 1, 15), 16, 10).cast("long")
        return x.withColumn("h", h).withColumn("bin", F.shiftright("h", HASH_BITS - power).cast("int"))

    goal = targets(small.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, max_epochs)
    whole = F.least(F.floor(F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)) + 1e-12), F.lit(int(max_epochs)))
    goal = small_side(checkpointed(goal.select(F.col("source").alias("of"), "source_size", "target", whole.alias("whole"), (F.col("target") - whole * F.col("source_size")).alias("need"))))
    # tables of sources have one row per source and are joined on by name
    with_goal = lambda x: x.join(goal, F.col("source").eqNullSafe(F.col("of")), "left").drop("of").withColumn("long", F.col("size") * LONG > F.col("need"))
    keys = with_goal(hashed(small.where("size > 0"))).groupBy("source", "bin", "h", "doc_id", "size", "need", "source_size", "long").agg((F.count(F.lit(1)) * F.col("size")).alias("words"))
    keys = checkpointed(keys)
    long, short = keys.where("long"), keys.where("NOT long")
    share = long.groupBy(F.col("source").alias("of")).agg((F.sum("words") * F.first("need") / F.first("source_size")).alias("rest"))
    first = small_side(checkpointed(_cuts(long, share, "first")))
    got = long.join(first, F.col("source").eqNullSafe(F.col("of"))).where(_within("first")).groupBy("source").agg(F.sum("words").alias("got"))
    rest = goal.join(got, F.col("of").eqNullSafe(F.col("source")), "left").select("of", (F.col("need") - F.coalesce("got", F.lit(0))).alias("rest"))
    second = small_side(checkpointed(_cuts(short, rest, "second")))
    every = with_goal(hashed(rows if keep else small))
    for cut in (first, second):
        every = every.join(cut, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    more = F.when(F.col("long"), _within("first")).otherwise(_within("second")).cast("int")
    repeats = F.when(F.col("size") > 0, F.coalesce(F.col("whole"), F.lit(0)) + more).otherwise(0).cast("long")
    return every.select("doc_id", "size", "source_size", "target", repeats.alias("repeats"), (F.col("size") * repeats).alias("taken"), *[F.col(f"kept_{c}").alias(c) for c in keep])


def duckdb_sql(weights: list[float], budget: float, max_epochs: float, seed: int) -> str:
    """``mix`` of ``documents`` in DuckDB SQL: the same fill and samples, by running sums over whole sources."""
    w = ", ".join(str(float(x)) for x in weights)
    running = lambda part: f"sum(words) OVER (PARTITION BY source, long ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - words / 2.0::DOUBLE AS {part}"
    return f"""
    WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
    p AS (SELECT *, [{w}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} + 1]::DOUBLE AS w, sum(source_size) OVER ()::BIGINT * {float(budget)}::DOUBLE AS total FROM s),
    c AS (SELECT *, CASE WHEN w > 0 THEN source_size * {float(max_epochs)}::DOUBLE ELSE 0 END AS cap FROM p),
    o AS (SELECT *, row_number() OVER (ORDER BY cap / nullif(w, 0) NULLS FIRST, source NULLS LAST) AS nth FROM c),
    l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / nullif(sum(w) OVER (ORDER BY nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS level FROM o),
    t AS (SELECT source, source_size, CASE WHEN (SELECT min(nth) FROM l WHERE cap > level * w) IS NULL THEN cap ELSE least(cap, w * (SELECT level FROM l WHERE nth = (SELECT min(nth) FROM l WHERE cap > level * w))) END AS target FROM l),
    g AS (SELECT *, least(floor(coalesce(target / nullif(source_size, 0), 0) + 1e-12::DOUBLE), {int(max_epochs)})::BIGINT AS whole FROM t),
    n AS (SELECT *, target - whole * source_size AS need FROM g),
    k AS (SELECT d.source, ('0x' || substr(md5('{seed}:' || coalesce('s' || d.source, '') || ':' || coalesce(d.doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h, d.doc_id, d.size, count(*) * d.size AS words, d.size * {LONG} > any_value(need) AS long
      FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source WHERE d.size > 0 GROUP BY 1, 2, 3, 4),
    m AS (SELECT *, {running("mid")} FROM k),
    a AS (SELECT n.source, any_value(need) * sum(words) / any_value(source_size) AS share FROM m JOIN n ON m.source IS NOT DISTINCT FROM n.source WHERE long GROUP BY 1),
    x AS (SELECT m.*, mid < share AS first FROM m LEFT JOIN a ON m.source IS NOT DISTINCT FROM a.source AND long),
    b AS (SELECT n.source, any_value(need) - coalesce(sum(CASE WHEN first THEN words END), 0) AS rest FROM n LEFT JOIN x ON x.source IS NOT DISTINCT FROM n.source GROUP BY 1),
    y AS (SELECT x.source, doc_id, size, CASE WHEN long THEN first ELSE mid < rest END AS more FROM x JOIN b ON x.source IS NOT DISTINCT FROM b.source),
    z AS (SELECT d.doc_id, d.size, n.source_size, n.target, CASE WHEN d.size > 0 THEN n.whole + more::BIGINT ELSE 0 END AS repeats
      FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source LEFT JOIN y ON y.source IS NOT DISTINCT FROM d.source AND y.doc_id IS NOT DISTINCT FROM d.doc_id AND y.size = d.size)
    SELECT doc_id, size, source_size, target, (size * repeats)::BIGINT AS taken, repeats::BIGINT AS repeats FROM z
    """
