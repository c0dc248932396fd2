"""Helpers that the operators share."""

from __future__ import annotations

import os
import sys
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parents[2]


def ship() -> None:
    """Where workers can't import this package from their path, functions travel by value."""
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(":")]
    if str(ROOT) not in [os.path.realpath(p) for p in known if p]:
        for name in [n for n in sys.modules if n.startswith("driftgauge.llm")]:
            cloudpickle.register_pickle_by_value(sys.modules[name])


def shared_folder(sc: SparkContext) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, a local session gets a temporary folder, and a cluster an error: its machines share none."""
    if found := sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir():
        return found.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="driftgauge-")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage by a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(sc))
    return df.checkpoint(eager=True)


#: Keys that hold more than one row in so many are hot: never more than so many keys.
HOT_KEYS = 10_000
LEAST_HOT = 1_000


def matched(rows: DataFrame, table: DataFrame, on: list[str], total: int, count: str = "c") -> DataFrame:
    """``rows`` joined to ``table``, which has one row per key and how many rows have it (``count``); ``total``: the sum of these.

    A table of at most 10,000 rows is broadcast. Of a greater one, rows of hot keys stay where they are and get their key's row by
    broadcast: keys with more than max(1,000, total / 10,000) rows are at most 10,000. All other keys meet by shuffling, at most that
    many rows to a key. ``table`` should be checkpointed: it is read more than once.
    """
    if total <= LEAST_HOT:
        return rows.join(table, on)
    if table.limit(HOT_KEYS + 1).count() <= HOT_KEYS:
        return rows.join(F.broadcast(table), on)
    most = max(LEAST_HOT, total // HOT_KEYS)
    hot = table.where(F.col(count) > most)
    if hot.isEmpty():
        return rows.join(table, on)
    rest = rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(table.where(F.col(count) <= most), on)
    return rest.unionByName(rows.join(F.broadcast(hot), on))


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def small_side(df: DataFrame, most: int = 10_000) -> DataFrame:
    """``df`` to be broadcast if it has at most ``most`` rows (it should be checkpointed: it is counted), else as it is, for Spark to join by shuffling."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def beside(df: DataFrame, *made: str) -> tuple[list[str], str]:
    """Columns of ``df`` that stay, and their schema text; those named like a made one give way to it."""
    kept = [f for f in df.schema if f.name not in made]
    return [f.name for f in kept], "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)


def slices(batch: pa.RecordBatch, column: int, most_bytes: int = 1 << 20, most_rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Consecutive pieces of ``batch`` of about ``most_bytes`` of text at most, so that a worker's memory stays bounded."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(size):
        if i > start and (held + n > most_bytes or i - start >= most_rows):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < len(size):
        yield batch.slice(start)


def map_texts(df: DataFrame, keep: list[str], text: str, work: Callable, schema: str, *extra: str) -> DataFrame:
    """``work`` over (kept columns, extra columns, whole text) in bounded slices.

    ``work`` is made once a task by calling the factory ``work()``; it maps a record batch to arrays for ``schema``.
    """
    ship()
    cols = [F.col(c) for c in keep] + [F.col(c) for c in extra] + [text_or_empty(text).alias("__text")]
    at = len(cols) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = work()
        for batch in batches:
            for part in slices(batch, at):
                yield step(part)

    return df.select(*cols).mapInArrow(run, schema)
