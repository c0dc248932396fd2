"""Collects raw results of a scoring run into shards, one per benchmark, mode, model and language, and reports on each.

    python -m jobs.collect_shards --source PATH --out PATH [--config jobs/collect_shards.json]

The configuration says by expressions how a row of ``source`` gives a shard's key, an item, the option that was predicted (-1: none) and the
right one; of rows of an item in one shard the last by ``place`` counts. A run writes

* ``out/shards/benchmark=.../mode=.../model=.../language=...``: item, prediction and mark;
* ``out/done/...``: a marker with the rows of each shard, once the shard is whole;
* ``out/metrics/benchmark=.../language=...``: by shard the accuracy, the gap to the source language, the rate of unparseable predictions, the share of the
  modal option, and flags. Only items that every language of the benchmark has count there, by all shards as they then are; a benchmark of which a
  language has more than ``most_unshared`` other items is refused: its versions aren't the same test.

A run replaces the shards that it writes and leaves others, so running it again, or after it broke off, gives the same result. With ``resume`` shards that
have their marker are left as they are.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgauge.operators import panel, scores
from driftgauge.sources import shards
from driftgauge.streaming.shards import metrics

log = logging.getLogger("jobs.collect_shards")
CONFIG = Path(__file__).with_suffix(".json")
METRICS = "mode string, model string, n_items long, accuracy double, gap double, unparseable double, mode_share double, flag_unparseable boolean, flag_degenerate boolean, benchmark string, language string"


def read_config(path: str | Path = CONFIG) -> dict:
    return json.loads(Path(path).read_text())


def responses(raw: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(shard key, item_id, predicted, correct), one row per item of a shard."""
    r = raw.select(*[F.expr(e).alias(c) for c, e in columns.items()])
    last = r.groupBy(*shards.KEY, "item_id").agg(F.max_by(F.struct("predicted", "answer"), "place").alias("r"))
    predicted = F.coalesce("r.predicted", F.lit(-1)).cast("smallint")
    return last.select(*shards.KEY, "item_id", predicted.alias("predicted"), F.coalesce(predicted == F.col("r.answer"), F.lit(False)).cast("tinyint").alias("correct"))


def aligned(rows: DataFrame, most: float) -> DataFrame:
    """The items that every language of their benchmark has; raises if the benchmark isn't parallel."""
    name = F.struct("benchmark", "item_id")
    ids = rows.select("benchmark", "language", "item_id").distinct()
    per = ids.groupBy("benchmark").agg(F.count_distinct("language").alias("of"))
    shared = ids.groupBy("benchmark", "item_id").agg(F.count(F.lit(1)).alias("n")).join(per, "benchmark").where("n = of").select("benchmark", "item_id")
    named = panel.coverage(ids.select(F.struct("benchmark", "language").alias("lang"), name.alias("item_id")), shared.select(name.alias("item_id")))
    panel.check_parallel(named, most)
    return rows.join(shared, ["benchmark", "item_id"], "left_semi")


def measured(rows: DataFrame, source: str) -> DataFrame:
    """The metrics of each shard, and its accuracy's distance to that of the model's shard in the source language."""
    found = metrics(rows).withColumn("run", F.struct("benchmark", "mode", "model"))
    return scores.source_gap(found, "accuracy", source, model="run").drop("run")


def run(spark: SparkSession, source: str, out: str, config: dict) -> dict[str, int]:
    raw = spark.read.format(config["format"]).load(source)
    rows = responses(raw, config["columns"])
    if config["resume"]:
        rows = panel.outstanding(rows, shards.done(spark, f"{out}/shards"), *shards.KEY)
    n_shards, written = shards.write(rows, f"{out}/shards")
    counts = {"read": raw.count(), "shards": n_shards, "written": written}
    log.info("read %d rows of %s, wrote %d rows to %d shards under %s/shards", counts["read"], source, written, n_shards, out)
    made = measured(aligned(shards.read(spark, f"{out}/shards"), config["most_unshared"]), config["source_language"])
    made.select([c.split()[0] for c in METRICS.split(", ")]).coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("benchmark", "language").parquet(f"{out}/metrics")
    log.info("wrote the metrics of all shards to %s/metrics", out)
    return counts


def read_back(spark: SparkSession, out: str) -> DataFrame:
    """Every response beside its shard's metrics."""
    told = spark.read.schema(METRICS).parquet(f"{out}/metrics")
    return shards.read(spark, f"{out}/shards").join(told, shards.KEY, "left")


def main() -> None:
    from driftgauge.session import session

    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("source", "out"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config", default=str(CONFIG))
    a = p.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = session("collect-shards")
    try:
        run(spark, a.source, a.out, read_config(a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
