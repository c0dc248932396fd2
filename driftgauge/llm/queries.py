"""The queries opN_<name> over the test tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, jaccard, mixing, mpeg, neighbours, pieces, pii, quality, runs, sketch, tokencount, urls
from ._common import text_or_empty

#: Production keys come from a secret store; this one only makes the queries' results repeatable.
KEY = b"driftgauge demonstration key"
SEED = 17
SAID = "</s>[INST] ok [/INST]"
WEIGHTS = [5.0, 2.0, 1.0]
#: One in so many shingle hashes is kept by ``op10_sketch``: short texts need dense sketches.
ONE_IN = 2
RULES: list[urls.Rule] = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file is, on this machine and on every worker."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-7).cast("long"), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(SAID))
    return chat.read_back(chat.prefix_target_examples(rows.union(own)))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = quality.train(docs, table(spark, sf_dir, "labels").where(~held_out))
    scored = quality.score(docs, model, lines="lines")
    return scored.select(
        "doc_id",
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("lines", lambda x: x.good >= 0.5)).cast("long").alias("n_good_lines"),
    )


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokencount.count_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


def op5_mpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    probed = mpeg.probe(mpeg.store(table(spark, sf_dir, "documents")))
    tail = F.crc32(F.substring("payload", -32, 32))
    return probed.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        tail.alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.format_string("frames=%d samples=%d rate=%d table=%s/%d/%s crc=%d/%d resyncs=%d junk=%d tags=%s last=%d", "frames", "samples", "rate", "vbr_table", "table_frames", "table_ok", "crc_ok", "crc_bad", "resyncs", "junk_bytes", F.array_join("tags", "+"), F.element_at("frame_offsets", -1)).alias("feature"),
        "seconds",
        F.sha2(F.array_join("frame_offsets", ","), 256).alias("frame_offsets_sha256"),
    )


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = pieces.load(tokenizer("piece_bpe_32k.model"))
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty("text").alias("text"))
    both = pieces.decode(pieces.encode(docs.select("doc_id", "text", F.sha2("text", 256).alias("text_sha256")), model), model)
    lowest, highest = min(model.byte_of, default=0), max(model.byte_of, default=-1)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.size(F.filter("ids", lambda i: i.between(lowest, highest))).cast("long").alias("n_byte_pieces"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.sha2("decoded", 256) == F.col("text_sha256")).alias("round_trip"),
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), WEIGHTS, budget=1.5, max_epochs=2.0, seed=SEED).select("doc_id", "size", "source_size", "target", "taken", "repeats")


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), RULES, keep=["page_id"]).drop("score")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), KEY)
    return done.select("doc_id", F.col("pseudonymised").alias("text"), *[F.col(f"found.{k}").cast("long").alias(f"n_{k}") for k in pii.KINDS])


def op10_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty("text").alias("text"))
    both = sketch.with_next(docs, ["doc_id", "text"], ["text", "own"], prepared=lambda d: sketch.fingerprints(d, column="own", one_in=ONE_IN))
    n = F.length("text").cast("long")
    cut = F.floor(n / 4)
    edited = F.concat(F.substring("text", F.lit(1), (n - cut).cast("int")), F.substring("next_text", F.lit(1), cut.cast("int")))
    done = both.select("doc_id", n.alias("n_chars"), edited.alias("edited"), "own", "next_own")
    done = sketch.fingerprints(done, text="edited", column="changed", one_in=ONE_IN)
    return done.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        sketch.hexed(F.col("own")).alias("fingerprint"),
        sketch.hexed(F.col("changed")).alias("edited_fingerprint"),
        sketch.likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        sketch.likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )


def op11_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.search(rows, rows.where("vec_id % 20 = 0"), k=20)


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", runs.looped().alias("text"))
    done = runs.periodic_runs(docs).withColumn("best", runs.steepest())
    best = F.col("best")
    return done.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"),
        F.sha2(runs.listed(), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_chat, op2_quality, op3_jaccard, op4_tokens, op5_mpeg, op6_pieces, op7_mixing, op8_urls, op9_pii, op10_sketch, op11_hnsw, op12_runs, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat": chat.duckdb_sql([(-7, 0, "user", SAID), (-7, 1, "assistant", SAID)]),
        "op3_jaccard": jaccard.duckdb_sql(3, 90, 100),
        "op7_mixing": mixing.duckdb_sql(WEIGHTS, 1.5, 2.0, SEED),
        "op8_urls": urls.duckdb_sql(RULES),
        "op12_runs": runs.duckdb_sql(),
    }


