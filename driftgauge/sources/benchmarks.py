"""Raw benchmark tables to parallel items, with a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import items as I
from ..operators import panel
from ..operators.ordered import running
from ..session import cut
from .specs import BenchmarkSpec


def scan(spark: SparkSession, path: str, spec: BenchmarkSpec, languages: list[str] | None = None) -> DataFrame:
    """Parquet (or JSON lines) partitioned by ``lang``, and by ``split`` and ``revision`` where the table has them: the filters prune partitions, and only
    mapped columns are read. A table without these columns is taken to be of the specification's split and revision."""
    reader = spark.read.json if path.endswith((".json", ".jsonl")) else spark.read.parquet
    df = reader(path)
    df = df.where(F.col("lang").isin(list(languages or spec.languages)))
    for c, v in (("split", spec.split), ("revision", spec.revision)):
        if v is not None and c in df.columns:
            df = df.where(F.col(c) == v)
    return df


def build_items(rows: DataFrame, spec: BenchmarkSpec, order: str | None = None) -> DataFrame:
    """(item_id, language, prompt, options, answer_index, strata, malformed) of rows with ``lang``; ``order`` gives the row index where ids need one."""
    f = spec.fields
    position = None
    if order:  # a row's place in its language, counted without gathering the language
        rows = running(rows.withColumn("__one", F.lit(1)), ["lang"], order, {"__place": "__one"})
        position = F.col("__place") - 1
    ids = I.item_id(spec.item_id_field, position)
    strata = f.get("strata") or []
    strata_map = F.create_map(*[x for s in strata for x in (F.lit(s), F.coalesce(F.col(s).cast("string"), F.lit("")))]) if strata else F.create_map().cast("map<string,string>")
    question, context = I.question_of(f)
    if spec.task == "generative":
        options = F.array(F.col(f["answer"]).cast("string"))
        answer, prompt, bad = F.lit(0), question, F.lit(False)
    else:
        raw = I.options_of(f)
        options = I.stripped_options(raw)
        answer = I.answer_index(F.col(f["answer"]), f.get("answer_base", spec.extra.get("answer_base")), F.size(options))
        prompt = I.choice_prompt(question, options, context)
        bad = I.has_hole(raw) | answer.isNull() | (F.size(options) < 2)
    return rows.select(ids.alias("item_id"), F.col("lang").alias("language"), prompt.alias("prompt"), options.alias("options"), answer.cast("int").alias("answer_index"), strata_map.alias("strata"), bad.alias("malformed"), *([F.col(order).alias("__order")] if order else []))


def load(rows: DataFrame, spec: BenchmarkSpec, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(items, manifest): malformed items dropped everywhere, the shared ones selected under the cap, and the gates applied."""
    built = cut(build_items(rows, spec, order))  # read by the gates, the selection and the result
    if spec.task != "generative":
        built = panel.drop_malformed(built, lang="language")
    if order:
        built = panel.last_rows(built, "__order", lang="language").drop("__order")
    selected, covered = panel.select_items(built, spec.max_items, spec.seed, lang="language")
    panel.check_parallel(covered, lang="language")
    chosen = built.join(selected, "item_id", "left_semi").drop("malformed")
    return chosen, record_of(spec, selected, covered)


def record_of(spec: BenchmarkSpec, selected: DataFrame, covered: DataFrame) -> DataFrame:
    """The manifest, one row: the specification's seed, cap and source language, the selected ids (thousands) and each language's coverage."""
    record = covered.agg(F.map_from_entries(F.collect_list(F.struct("language", F.struct("n_total", "n_unshared")))).alias("coverage"))
    ids = selected.agg(F.count(F.lit(1)).alias("n_items"), F.array_sort(F.collect_list("item_id")).alias("item_ids"))
    return record.crossJoin(ids).select(F.lit(spec.name).alias("benchmark"), F.lit(spec.seed).cast("long").alias("seed"), F.lit(spec.max_items).cast("int").alias("max_items"), F.lit(spec.source_language).alias("source_language"), "n_items", "item_ids", "coverage")


def probe(rows: DataFrame, spec: BenchmarkSpec) -> DataFrame:
    """One row: mapped columns that are missing, languages present and missing, rows and distinct ids by language, and whether the id looks like one (at least 0.9 of the rows)."""
    ids = [spec.item_id_field] if isinstance(spec.item_id_field, str) else list(spec.item_id_field or [])
    f = spec.fields
    wanted = {c for k in ("question", "premise", "hypothesis", "answer") if (c := f.get(k))} | {c for k in ("options", "context") for c in ([f[k]] if isinstance(f.get(k), str) else f.get(k) or [])} | {i for i in ids if i != "__row_index__"}
    gone = sorted(wanted - set(rows.columns))
    known = [i for i in ids if i in rows.columns]
    key = F.concat_ws(I.JOINT, *[F.col(i).cast("string") for i in known]) if known else F.lit(None).cast("string")
    by = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("ids"))
    listed = F.array(*[F.lit(x) for x in spec.languages]).cast("array<string>")
    return by.agg(F.array_sort(F.collect_list("lang")).alias("present"), F.sum("n").alias("n_rows"), F.max("n").alias("most_rows"), F.min(F.col("ids") >= 0.9 * F.col("n")).alias("ids_ok")).select(
        F.lit(spec.name).alias("benchmark"), "present", F.array_except(listed, "present").alias("missing_languages"), F.array(*[F.lit(x) for x in gone]).cast("array<string>").alias("missing_columns"), "n_rows", "most_rows", "ids_ok"
    )
