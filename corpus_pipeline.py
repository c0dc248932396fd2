"""A training corpus in five stages: quality, near duplicates, personal data, mixing, pieces.

Every stage is ``f(spark, docs, sf_dir)`` over all that the one before kept; ``run`` writes each stage's rows as Parquet
into the shared folder of ``spark.checkpoint.dir`` and rereads them as the next one's docs; the rows of a stage that the next
one has written are removed, those of the last one stay.

Defined results of every stage: only the columns of ``documents`` are read, others are dropped, whatever their names; an empty
table gives an empty one; null and empty texts pass the middle stages unchanged and have no pieces, texts of any length are
taken whole, and repeated rows count each for itself (but for near duplicates, where one of them stays).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgauge.llm import jaccard, mixing, pieces, pii, quality
from driftgauge.llm._common import checkpointed, matched, shared_folder
from driftgauge.llm.queries import KEY, SEED, WEIGHTS, table, tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that score 0.5 or more; labels of the held-out third are never read.

    A text without lines scores the share of good labels, so all of these stay or go alike; without labels of both kinds so do all texts.
    """
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = quality.train(docs, table(spark, sf_dir, "labels").where(~held_out))
    return quality.score(docs.select(COLUMNS), model).where("score >= 0.5").select(COLUMNS)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, the one with the least id; shingles of five words, Jaccard similarity of 0.8.

    Defined results: rows that share an id, or have none, are documents of their own; ties go to the least digest of the text, then of the
    other columns, and null ids come last, so of equal rows one stays. Texts without words all stay. Only where ids
    repeat or are null, the documents are checkpointed once, with a number for each row.
    """
    docs, pick = docs.select(COLUMNS), {"k": 5, "num": 80, "den": 100}
    if docs.groupBy(F.col("doc_id").cast("long").alias("id")).count().where("id IS NULL OR count > 1").isEmpty():
        gone = jaccard.jaccard_components(docs, **pick).where("component_id <> doc_id").select(F.col("doc_id").alias("gone"))
        return docs.join(gone, F.col("doc_id") == F.col("gone"), "left_anti")
    docs = checkpointed(docs.withColumn("row", F.monotonically_increasing_id()))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.sha2("text", 256), "lang", "source", "n_chars", "row")
    found = jaccard.jaccard_components(docs, **pick, doc_id="row").select(F.col("doc_id").alias("row"), "component_id")
    found = found.join(docs.select("row", order.alias("order")), "row")
    first = checkpointed(found.groupBy("component_id").agg(F.min("order")["row"].alias("stays"), F.count(F.lit(1)).alias("c")).where("c > 1"))
    total = first.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    gone = matched(found, first, ["component_id"], total).where("row <> stays").select(F.col("row").alias("gone"))
    return docs.join(gone, F.col("row") == F.col("gone"), "left_anti").select(COLUMNS)


def private_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, dates and addresses become pseudonyms; null texts stay null, and ``n_chars`` counts the new text (null for null)."""
    done = pii.pseudonymise(docs.select(COLUMNS), KEY)
    return done.withColumn("text", F.col("pseudonymised")).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by weight, 150 % of all words, two epochs at most; a document comes out as often as the mix takes it, one without words never."""
    mixed = mixing.mix(docs, WEIGHTS, budget=1.5, max_epochs=2.0, seed=SEED, keep=["text", "lang", "source", "n_chars"])
    return mixed.where("repeats > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int")))).select(COLUMNS)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each text, as ``ids``; none for a null or empty text."""
    return pieces.encode(docs.select(COLUMNS), pieces.load(tokenizer("piece_bpe_32k.model")))


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicates_stage),
    ("PII", private_stage),
    ("mixing", mixing_stage),
    ("SentencePiece", pieces_stage),
]

#: Models, hashes and permutations aren't SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark.sparkContext)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            _remove(spark, f"{folder}/{i - 1}")
    return docs


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
