"""Views that give the star-schema test tables the shape of evaluation results, in Spark and as DuckDB text.

Each view uses its tables whole. Models are nations, items parts, languages regions; region 0 is the source language.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread

SOURCE = 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crossed(spark: SparkSession, sf_dir: str, salt: str = "") -> DataFrame:
    """responses (model, item, language, correct): every nation on every part in every region, dealt by item. The dimensions broadcast: 25 and 5 rows."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("model"), F.col("n_nationkey").cast("string").alias("m"))
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("int").alias("language"), F.col("r_regionkey").cast("string").alias("l"))
    p = spread(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("item"), F.col("p_size").cast("int").alias("size"), F.col("p_partkey").cast("string").alias("i")), "item")  # as text before the cells are made
    cells = p.crossJoin(F.broadcast(n.crossJoin(F.broadcast(r))))
    h = F.conv(F.substring(F.sha2(F.concat_ws(":", "m", "i", "l", *([F.lit(salt)] if salt else [])), 256), 1, 8), 16, 10).cast("long") % 100
    return cells.select("model", "item", "language", (h < 40 + 2 * F.col("model") - 4 * F.col("language") - F.col("size") % 20).cast("int").alias("correct"))


def crossed_sql(salt: str = "") -> str:
    end = f" || ':{salt}'" if salt else ""
    return f"""(SELECT n_nationkey AS model, p_partkey AS item, r_regionkey AS language,
      CASE WHEN ('0x' || substr(sha256(n_nationkey || ':' || p_partkey || ':' || r_regionkey{end}), 1, 8))::BIGINT % 100 < 40 + 2 * n_nationkey - 4 * r_regionkey - p_size % 20 THEN 1 ELSE 0 END AS correct
      FROM nation, part, region)"""


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An incomplete panel from events: (model, item, language, correct)."""
    e = table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 19).cast("long").alias("model"), F.floor(F.col("event_id") / 50).cast("long").alias("item"), F.col("event_type").alias("language"), (F.col("value") > 50).cast("int").alias("correct"))


OBSERVED = "(SELECT user_id % 19 AS model, event_id // 50 AS item, event_type AS language, CASE WHEN value > 50 THEN 1 ELSE 0 END AS correct FROM events)"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, language, predicted) from events; -1 is unparseable, and some cells collapse onto one option."""
    e = table(spark, sf_dir, "events")
    m = F.col("user_id") % 19
    option = F.when(F.col("event_id") % 11 == 0, -1).when(m % 6 == 5, 2).otherwise((F.col("event_id") * 7 + F.col("user_id")) % 4)
    return e.select(m.cast("long").alias("model"), F.col("event_type").alias("language"), option.cast("smallint").alias("predicted"))


PREDICTIONS = "(SELECT user_id % 19 AS model, event_type AS language, CASE WHEN event_id % 11 = 0 THEN -1 WHEN user_id % 19 % 6 = 5 THEN 2 ELSE (event_id * 7 + user_id) % 4 END AS predicted FROM events)"


def ids_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lang, item_id): the parts that were shipped under each return flag."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("lang"), F.col("l_partkey").cast("string").alias("item_id"))


IDS = "(SELECT l_returnflag AS lang, l_partkey::VARCHAR AS item_id FROM lineitem)"


def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given drift (item, language, delta, se): whole thousandths, most small, some large; 0 at the source."""
    p, r = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size", F.col("p_partkey").cast("long").alias("item")), "item"), table(spark, sf_dir, "region")
    h = (F.col("p_partkey") * 7919 + F.col("r_regionkey") * 104729 + F.col("p_size") * 31) % 2001 - 1000
    small = F.when(F.col("p_partkey") % 4 == 3, h * 2).otherwise(F.floor(h / 8) + 40 * F.col("r_regionkey"))
    d = F.when(F.col("r_regionkey") == SOURCE, 0).otherwise(small)
    return p.crossJoin(F.broadcast(r)).select("item", F.col("r_regionkey").cast("int").alias("language"), (d / 1000.0).cast("double").alias("delta"), (0.1 + F.col("p_size") % 10 / 50.0).cast("double").alias("se"))


DRIFT = f"""(SELECT p_partkey AS item, r_regionkey AS language, (CASE WHEN r_regionkey = {SOURCE} THEN 0 WHEN p_partkey % 4 = 3 THEN h * 2 ELSE floor(h / 8.0) + 40 * r_regionkey END / 1000.0::DOUBLE)::DOUBLE AS delta, 0.1::DOUBLE + (p_size % 10) / 50.0::DOUBLE AS se
  FROM (SELECT *, (p_partkey * 7919 + r_regionkey * 104729 + p_size * 31) % 2001 - 1000 AS h FROM part, region))"""


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given gaps (model, language, gap, share): 0 at the source; share is the modal option's."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    g = F.when(F.col("r_regionkey") == SOURCE, 0).otherwise((F.col("n_nationkey") * 13 + F.col("r_regionkey") * 29) % 41 - 12)
    share = (F.col("n_nationkey") * 7 + F.col("r_regionkey") * 5) % 100
    return n.crossJoin(F.broadcast(r)).select(F.col("n_nationkey").cast("int").alias("model"), F.col("r_regionkey").cast("int").alias("language"), (g / 20.0).cast("double").alias("gap"), (share / 100.0).cast("double").alias("share"))


GAPS = f"(SELECT n_nationkey AS model, r_regionkey AS language, (CASE WHEN r_regionkey = {SOURCE} THEN 0 ELSE (n_nationkey * 13 + r_regionkey * 29) % 41 - 12 END / 20.0::DOUBLE)::DOUBLE AS gap, ((n_nationkey * 7 + r_regionkey * 5) % 100 / 100.0::DOUBLE)::DOUBLE AS share FROM nation, region)"


def numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, text): each order's price written in one of six ways."""
    o = table(spark, sf_dir, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
    w, f = F.floor(F.col("cents") / 100), F.lpad((F.col("cents") % 100).cast("string"), 2, "0")
    commas = F.format_number(w, 0)
    forms = [
        F.concat(commas, F.lit("."), f),
        F.concat(F.translate(commas, ",", "."), F.lit(","), f),
        F.concat(F.lit("First 7, then 9. The answer: "), w.cast("string")),
        F.concat(F.lit("Total "), commas, F.lit(" items.")),
        F.lit("no number here"),
        F.concat(F.lit("-"), w.cast("string"), F.lit(" and "), f),
    ]
    kind = F.col("o_orderkey") % 6
    text = F.coalesce(*[F.when(kind == i, x) for i, x in enumerate(forms)])
    return o.select("o_orderkey", text.alias("text"), (F.col("cents") / 100).alias("price"))


#: What each way of writing means, worked out from the price and not from the text.
NUMERALS = """(SELECT o_orderkey, cents / 100.0::DOUBLE AS price, CASE o_orderkey % 6 WHEN 0 THEN cents / 100.0::DOUBLE WHEN 1 THEN cents / 100.0::DOUBLE WHEN 2 THEN (cents // 100)::DOUBLE WHEN 3 THEN (cents // 100)::DOUBLE WHEN 5 THEN (cents % 100)::DOUBLE END AS number
  FROM (SELECT *, round(o_totalprice * 100)::BIGINT AS cents FROM orders))"""


def parameters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Given ability (model, language, theta) and difficulty (item, b)."""
    n, r, p = (table(spark, sf_dir, t) for t in ("nation", "region", "part"))
    ability = n.crossJoin(F.broadcast(r)).select(F.col("n_nationkey").cast("int").alias("model"), F.col("r_regionkey").cast("int").alias("language"), ((F.col("n_nationkey") - 12) / 8.0 - F.col("r_regionkey") / 5.0).alias("theta"))
    return ability, p.select(F.col("p_partkey").cast("long").alias("item"), ((F.col("p_size") % 21 - 10) / 5.0).alias("b"))


ABILITY = "(SELECT n_nationkey AS model, r_regionkey AS language, (n_nationkey - 12) / 8.0::DOUBLE - r_regionkey / 5.0::DOUBLE AS theta FROM nation, region)"
DIFFICULTY = "(SELECT p_partkey AS item, (p_size % 21 - 10) / 5.0::DOUBLE AS b FROM part)"
