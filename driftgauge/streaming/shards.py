"""Shard metrics, and which benchmarks are whole, kept up to date while shards arrive: extensions beyond batch reports."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import scores
from ..sources.shards import KEY, marks

SCHEMA = "benchmark string, mode string, model string, language string, item_id string, correct tinyint, predicted smallint"


def metrics(responses: DataFrame) -> DataFrame:
    """Accuracy, unparseable rate and modal share by shard."""
    by = ["benchmark", "mode", "model", "language"]
    acc = scores.accuracy(responses, *by).join(scores.unparseable_rate(responses, *by), by)
    return scores.flags(acc.join(scores.mode_share(responses, *by), by).withColumn("mode_share", F.when(F.col("mode") != "generative", F.col("mode_share"))))


def follow(spark: SparkSession, source: str, checkpoint: str, sink: str, once: bool = True) -> StreamingQuery:
    """Reads new shard files as they come; each batch writes the metrics of the shards that it holds to a partition of its own, which a retried batch overwrites. A shard is one file, so its metrics are final."""
    stream = spark.readStream.schema(SCHEMA).parquet(source)

    def put(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            metrics(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")
        finally:
            batch.unpersist()

    out = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()


class Crossed(StatefulProcessor):
    """The shards of one benchmark that are there; a row once all that are wanted are, and again only if more are wanted by then."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.shards = handle.getMapState("shards", "mode string, model string, language string", "n_rows long, digest long")
        self.told = handle.getValueState("told", "n_shards long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timers: Any) -> Iterator[Row]:
        wanted = digest = n_rows = n_held = 0
        for r in rows:
            self.shards.updateValue((r.mode, r.model, r.language), (r.n_rows, r.digest))
            wanted, digest = r.n_wanted, r.wanted_digest
        for n, d in self.shards.values():
            n_rows, n_held, digest = n_rows + n, n_held + 1, digest ^ d
        # as many as are wanted, and the same ones: then the digests cancel out
        if n_held == wanted and digest == 0 and (not self.told.exists() or self.told.get()[0] < wanted):
            self.told.update((wanted,))
            yield Row(benchmark=key[0], n_shards=wanted, n_rows=n_rows)

    def close(self) -> None:
        pass


STATE = "spark.sql.streaming.stateStore.providerClass"


def follow_complete(spark: SparkSession, path: str, wanted: DataFrame, checkpoint: str, sink: str, once: bool = True) -> StreamingQuery:
    """Writes (benchmark, n_shards, n_rows) to ``sink`` when the last of a benchmark's ``wanted`` shards (their key) is whole under ``path``.

    Follows the markers of the shard sink, one row a shard, so that state is as large as the grid and not as the responses. A shard that isn't wanted, or is written
    again, tells nothing new. State and what was told outlive a restart; a grid that has grown by then is told again once it is whole. A grid that has lost shards which
    are there already is never told: give it a checkpoint of its own.
    """
    grid = wanted.select(*KEY).distinct().withColumn("digest", F.xxhash64(*KEY))
    grid = grid.join(grid.groupBy("benchmark").agg(F.count(F.lit(1)).alias("n_wanted"), F.bit_xor("digest").alias("wanted_digest")), "benchmark")
    schema = ", ".join(["n_rows long", *(f"{k} string" for k in KEY)])
    # a marker that is replaced while it is read comes again under its new name
    marked = spark.readStream.schema(schema).option("ignoreMissingFiles", "true").parquet(marks(path)).join(grid, KEY)
    whole = marked.groupBy("benchmark").transformWithState(Crossed(), "benchmark string, n_shards long, n_rows long", "append", "none")
    out = whole.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    before = spark.conf.get(STATE)
    spark.conf.set(STATE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # what keyed state needs; a query keeps the settings that it started with
    try:
        return (out.trigger(availableNow=True) if once else out).start(sink)
    finally:
        spark.conf.set(STATE, before)


def windowed_events(spark: SparkSession, source: str, schema: str, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Event counts and sums in tumbling windows behind a watermark, from a folder of Parquet files."""
    events = spark.readStream.schema(schema).parquet(source)
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
