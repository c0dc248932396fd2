"""Reads generated answers as files of them arrive, and keeps a report by language and model up to date.

    python -m jobs.mark_answers --source PATH --out PATH --checkpoint PATH [--config jobs/mark_answers.json]

``source`` is a folder (or a file) of Parquet with an id, a text, its language and the model that wrote it. A run takes the files that no run before has
taken, and ends. It writes

* ``out/answers/batch=.../lang=...``: an answer's final numeral in digits of any script (null: unparseable) and its length in words, characters and bytes;
* ``out/sums/batch=...``: sums by language and model of what that batch wrote;
* ``out/report/lang=...``: over all batches, the rate of unparseable answers and the mean length against that of the base language.

The checkpoint says which files were taken. A batch that failed is taken again with its number and replaces what it wrote, so each answer counts
once, whatever was interrupted; answers whose id came in an earlier batch (a file delivered again under another name) are left out, and of
rows of one batch that share an id the least stays. Rows without an id each count; a null text is an answer without words or numeral. The report is made from the sums alone.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgauge.functions import numerals

log = logging.getLogger("jobs.mark_answers")
CONFIG = Path(__file__).with_suffix(".json")
MEASURES = ["number", "n_words", "n_chars", "n_bytes"]
ANSWERS = "doc_id long, model string, number double, n_words long, n_chars long, n_bytes long, batch long, lang string"
SUMS = "lang string, model string, n_answers long, n_unparseable long, words long, chars long, bytes long, batch long"
REPORT = "model string, n_answers long, unparseable double, flag_unparseable boolean, mean_words double, mean_chars double, mean_bytes double, chars_ratio double, lang string"


def read_config(path: str | Path = CONFIG) -> dict:
    return json.loads(Path(path).read_text())


def marked(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(doc_id, lang, model, number, n_words, n_chars, n_bytes); of rows that share an id the least."""
    r = rows.select(*[F.expr(e).alias(c) for c, e in columns.items()])
    text = F.coalesce("text", F.lit(""))
    words = F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")
    made = {"number": numerals.final_number(text), "n_words": words, "n_chars": F.length(text).cast("long"), "n_bytes": F.octet_length(text).cast("long")}
    r = r.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "model", *[c.alias(n) for n, c in made.items()])
    rest = ["lang", "model", *MEASURES]
    alone = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())  # in one pass over the texts
    return r.groupBy("doc_id", alone.alias("alone")).agg(F.min(F.struct(*rest)).alias("r")).select("doc_id", "r.*")


def sums(answers: DataFrame) -> DataFrame:
    total = {"words": "n_words", "chars": "n_chars", "bytes": "n_bytes"}
    return answers.groupBy("lang", "model").agg(F.count(F.lit(1)).alias("n_answers"), F.count_if(F.col("number").isNull()).alias("n_unparseable"), *[F.sum(c).alias(n) for n, c in total.items()])


def report(parts: DataFrame, base: str, most: float) -> DataFrame:
    """(lang, model, ...) from the batches' sums, a small table: as many rows as batches, languages and models."""
    names = ["n_answers", "n_unparseable", "words", "chars", "bytes"]
    r = parts.groupBy("lang", "model").agg(*[F.sum(n).alias(n) for n in names])
    mean = parts.where(F.col("lang") == base).agg((F.sum("chars") / F.sum("n_answers")).alias("base"))
    lang = parts.groupBy("lang").agg((F.sum("chars") / F.sum("n_answers")).alias("own")).crossJoin(F.broadcast(mean))  # one row
    r = r.join(lang.withColumnRenamed("lang", "of"), F.col("lang").eqNullSafe(F.col("of")))
    rate = F.col("n_unparseable") / F.col("n_answers")
    return r.select("lang", "model", "n_answers", rate.alias("unparseable"), (rate > most).alias("flag_unparseable"), *[(F.col(n) / F.col("n_answers")).alias(f"mean_{n}") for n in ("words", "chars", "bytes")], F.try_divide("own", "base").alias("chars_ratio"))


def earlier(spark: SparkSession, out: str, number: int) -> DataFrame | None:
    """The ids of the answers of other batches."""
    try:
        return spark.read.schema(ANSWERS).parquet(f"{out}/answers").where(F.col("batch") != number).select("doc_id")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def run(spark: SparkSession, source: str, out: str, checkpoint: str, config: dict) -> dict[str, int]:
    """Takes what is new, brings the report up to date, and returns what it read and wrote."""
    source = source.rstrip("/")
    # files are new if the checkpoint doesn't know them, however old they are
    files = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", config["files_per_batch"]).option("maxFileAge", "36500d")
    stream = files.parquet(f"{source[:-1]}[{source[-1]}]")  # as a pattern, since a stream takes a plain path for a folder
    done = {"batches": 0, "read": 0, "written": 0}

    def put(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        rows = marked(batch, config["columns"])
        if (known := earlier(own, out, number)) is not None:
            rows = rows.join(known, "doc_id", "left_anti")
        rows.hint("rebalance", "lang").write.mode("overwrite").partitionBy("lang").parquet(f"{out}/answers/batch={number}")
        wrote = own.read.schema(ANSWERS).option("basePath", f"{out}/answers").parquet(f"{out}/answers/batch={number}")
        sums(wrote).coalesce(1).write.mode("overwrite").parquet(f"{out}/sums/batch={number}")
        n = own.read.schema(SUMS).option("basePath", f"{out}/sums").parquet(f"{out}/sums/batch={number}").agg(F.coalesce(F.sum("n_answers"), F.lit(0))).first()[0]
        done["batches"] += 1
        done["written"] += n
        log.info("batch %d: wrote %d answers to %s/answers", number, n, out)

    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    done["read"] = sum(p["numInputRows"] for p in query.recentProgress)
    log.info("read %d rows of new files in %s, in %d batches", done["read"], source, done["batches"])
    if earlier(spark, out, -1) is not None:
        made = report(spark.read.schema(SUMS).parquet(f"{out}/sums"), config["base"], config["unparseable"])
        made.coalesce(1).write.mode("overwrite").partitionBy("lang").parquet(f"{out}/report")
        log.info("wrote the report to %s/report", out)
    return done


def read_back(spark: SparkSession, out: str) -> DataFrame:
    """Every answer beside the report of its language and model."""
    answers = spark.read.schema(ANSWERS).parquet(f"{out}/answers").drop("batch")
    told = spark.read.schema(REPORT).parquet(f"{out}/report").withColumnsRenamed({"lang": "of_lang", "model": "of_model"})
    return answers.join(told, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("model").eqNullSafe(F.col("of_model"))).drop("of_lang", "of_model")


def main() -> None:
    from driftgauge.session import session

    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("source", "out", "checkpoint"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config", default=str(CONFIG))
    a = p.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = session("mark-answers")
    try:
        run(spark, a.source, a.out, a.checkpoint, read_config(a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
