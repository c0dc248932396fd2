"""Shards of scored responses: Parquet partitioned by benchmark, mode, model and language, and archives of arrays."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..session import cut

KEY = ["benchmark", "mode", "model", "language"]
ARCHIVE = "benchmark string, mode string, model string, language string, item_id string, correct byte, predicted short, meta string"
MODES = ("letter", "loglik", "generative")


def write(responses: DataFrame, path: str) -> tuple[int, int]:
    """Writes shards, one folder each, and then a marker per shard with its rows; returns how many shards and rows.

    Shards that are there already are replaced, others stay: a run that is repeated, or broke off and is run again, leaves each shard once.
    A shard without its marker isn't ``done``. Large shards are split over several files.
    """
    target = lambda df, at: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEY).parquet(at)
    rows = cut(responses)  # what is written and what is marked are the same rows
    held = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_rows"))
    target(rows.hint("rebalance", *KEY), path)
    target(held.coalesce(1), marks(path))
    return held.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_rows"), F.lit(0))).first()


def marks(path: str) -> str:
    """Where the markers of the shards under ``path`` are."""
    return f"{path.rstrip('/')}.done"


def done(spark: SparkSession, path: str) -> DataFrame:
    """(shard key, n_rows) of the shards that are whole: resuming leaves them out (``panel.outstanding``). None before anything was written."""
    schema = ", ".join(["n_rows long", *(f"{k} string" for k in KEY)])
    try:
        return spark.read.schema(schema).parquet(marks(path))
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def _shards(spark: SparkSession, path: str) -> DataFrame:
    """The table with its keys as text, also where a model's name looks like a number."""
    found = spark.read.parquet(path).schema
    return spark.read.schema(StructType([StructField(f.name, StringType() if f.name in KEY else f.dataType) for f in found])).parquet(path)


def read(spark: SparkSession, path: str, benchmark: str | None = None, mode: str | None = None, models: list[str] | None = None, languages: list[str] | None = None) -> DataFrame:
    """The filters prune partitions: no file of another benchmark, mode, model or language is opened."""
    df = _shards(spark, path)
    for c, v in (("benchmark", benchmark), ("mode", mode)):
        df = df if v is None else df.where(F.col(c) == v)
    for c, v in (("model", models), ("language", languages)):
        df = df if v is None else df.where(F.col(c).isin(list(v)))
    return df


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """The shards that exist."""
    return _shards(spark, path).select(*KEY).distinct()


def with_specs(shards: DataFrame, specs: DataFrame) -> DataFrame:
    """(name, usable, matches, source_language, has_source, n_shards, n_models, n_languages) of every specification (``specs_frame``), joined to its shards
    (``catalogue``) by name; without shards the counts are 0. Specifications are few and go by broadcast if Spark's own size check says so."""
    per = shards.groupBy("benchmark", "mode").agg(F.count(F.lit(1)).alias("n_shards"), F.count_distinct("model").alias("n_models"), F.count_distinct("language").alias("n_languages"), F.collect_set("language").alias("seen"))
    both = specs.join(per, specs["name"] == per["benchmark"], "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_shards", "n_models", "n_languages")]
    return both.select("name", "usable", "mode", ((F.col("task") == "generative") == (F.col("mode") == "generative")).alias("matches"), "source_language", F.coalesce(F.array_contains("seen", F.col("source_language")), F.lit(False)).alias("has_source"), *counts)


def parse_name(stem: str) -> tuple[str, str, str] | None:
    """(model, language, mode) of an archive's name ``model__language[__mode]``; a name without a language is none."""
    mode = next((m for m in MODES[1:] if stem.endswith(f"__{m}")), "letter")
    core = stem[: -len(mode) - 2] if mode != "letter" else stem
    model, _, language = core.partition("__")
    return (model, language, mode) if language else None


def archive_files(spark: SparkSession, path: str, benchmark: str, mode: str = "letter", models: list[str] | None = None, languages: list[str] | None = None) -> DataFrame:
    """(model, language, length, content) of the ``.npz`` archives of one benchmark and mode, and of some models and languages.

    All filters are on the names of files, which Spark knows when it plans the scan: no other archive is opened, and a scan that takes no ``content`` opens none.
    Archives are whole files, so a task holds some of them and never a part of one.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(f"{path}/{benchmark}")
    name = F.url_decode(F.regexp_replace("_metadata.file_name", r"\+", "%2B"))  # names are shown as in a URL, where a plus stands for itself
    stem = F.regexp_replace(name, r"\.npz$", "")
    is_other = F.lit(False)
    for m in MODES[1:]:
        is_other |= F.endswith(stem, F.lit(f"__{m}"))
    core = stem if mode == "letter" else F.left(stem, F.length(stem) - len(mode) - 2)
    files = files.where((~is_other if mode == "letter" else F.endswith(stem, F.lit(f"__{mode}"))) & core.rlike("(?s)__."))
    model, language = F.substring_index(core, "__", 1), F.regexp_extract(core, "(?s)^.*?__(.+)$", 1)
    for c, v in ((model, models), (language, languages)):
        files = files if v is None else files.where(c.isin(list(v)))
    return files.select(model.alias("model"), language.alias("language"), "length", "content")


def read_archives(spark: SparkSession, path: str, benchmark: str, mode: str = "letter", models: list[str] | None = None, languages: list[str] | None = None) -> DataFrame:
    """Rows of the archives (item_ids, correct, predicted, meta) that ``archive_files`` finds."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import numpy as np

        for frame in frames:
            for model, language, data in zip(frame["model"], frame["language"], frame["content"], strict=True):
                z = np.load(io.BytesIO(data), allow_pickle=False)
                yield pd.DataFrame({"benchmark": benchmark, "mode": mode, "model": model, "language": language, "item_id": z["item_ids"].astype(str), "correct": z["correct"].astype("int8"), "predicted": z["predicted"].astype("int16"), "meta": str(z["meta"])})

    return archive_files(spark, path, benchmark, mode, models, languages).select("model", "language", "content").mapInPandas(run, ARCHIVE)


META = "hf_id string, revision string, n_items long, accuracy double, unparseable double, mode_share double, seconds double"


#: Numbers that JSON hasn't, where Python writes them bare: outside texts, so behind them come whole texts only.
_BARE = r'(?:-?Infinity|NaN)(?=[^"\\]*+(?:"(?:[^"\\]|\\.)*+"[^"\\]*+)*+$)'


def record(meta: str = "meta") -> F.Column:
    """The JSON record as a VARIANT, with whatever fields it has; bare NaN and infinities become texts that ``field`` reads as numbers. Null where it isn't JSON."""
    return F.try_parse_json(F.regexp_replace(meta, _BARE, '"$0"'))


def field(record: str | F.Column, path: str, type: str) -> F.Column:
    """A field of a VARIANT by its path (``$.a.b[0]``); null where it is missing or of no such type."""
    return F.try_variant_get(record, path, type)


def fields(records: DataFrame, record: str = "record", *by: str) -> DataFrame:
    """(by, fields): all fields that the records have, with the types that hold them all."""
    return records.groupBy(*by).agg(F.schema_of_variant_agg(record).alias("fields"))


def with_meta(rows: DataFrame) -> DataFrame:
    """The archive's JSON record as columns; NaN stays NaN. Fields beyond ``META`` stay in ``record``."""
    return rows.withColumn("record", record()).withColumn("meta", F.from_json("meta", META, {"allowNonNumericNumbers": "true"}))


def write_records(df: DataFrame, path: str) -> None:
    """Reports as JSON lines."""
    df.write.mode("overwrite").json(path)
