"""Specifications, benchmark loading, shards, and streams over temporary folders."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftgauge.operators.panel import outstanding
from driftgauge.plans import ablations, report
from driftgauge.sources import benchmarks, shards, specs
from driftgauge.streaming import shards as stream

TEXT = """
defaults: {split: test, source_language: en, max_items: 2000, seed: 20260803}
benchmarks:
  exam: {hf_id: org/exam, languages: [en, fr], item_id_field: sample_id, max_items: 3, answer_base: 1, fields: {question: q, options: [a, b, c], answer: ans, answer_base: 1, strata: [s]}}
  story: {hf_id: org/story, split: eval, languages: [en], note: kept}
  planned: {}
models:
  big: {hf_id: m/b, tier: 2, params_b: 9.2}
  small: {hf_id: m/s, tier: 2, params_b: 1.2}
  first: {hf_id: m/f, tier: 1, params_b: 7}
  other: {hf_id: m/o, tier: 3, params_b: 1}
"""


def test_specs(spark):
    s = specs.load_specs(TEXT)
    assert s["exam"].max_items == 3 and s["story"].max_items == 2000 and s["story"].split == "eval" and s["story"].extra == {"note": "kept"}
    assert s["exam"].usable and not s["planned"].usable
    assert [m.name for m in specs.load_models(TEXT)] == ["first", "small", "big"]
    assert {r.name for r in specs.matching_mode(specs.specs_frame(spark, s), "letter").collect()} == {"exam", "story", "planned"}


def test_specs_kept_as_rows(spark):
    given = {"defaults": {"split": "dev", "max_items": 9, "languages": ["xx"]}, "benchmarks": {"a": {"hf_id": "o/a", "languages": ["en", "fr"]}, "b": {"hf_id": "", "task": "generative", "seed": 4}, "c": {"source_language": "de", "split": "test"}}}
    held = spark.createDataFrame([(n, o.get("hf_id"), o.get("languages") and [*o["languages"][::-1], "en"], o.get("task"), o.get("seed"), o.get("source_language"), o.get("split"), 1) for n, o in given["benchmarks"].items()], "name string, hf_id string, languages array<string>, task string, seed int, source_language string, split string, usable int")
    got = specs.specs_over(held, given["defaults"])
    want = specs.specs_frame(spark, specs.load_specs(given))
    assert got.schema.names == want.schema.names and sorted(got.collect()) == sorted(want.collect())
    assert specs.specs_over(held.select("name")).where("usable OR hf_id IS NOT NULL OR split <> 'test' OR size(languages) > 0").isEmpty()
    assert specs.specs_over(held.limit(0)).count() == 0 and specs.specs_over(held.union(held)).count() == 6
    with pytest.raises(ValueError, match="no such fields"):
        specs.specs_over(held, {"splits": "x"})
    with pytest.raises(Exception, match="has no name"):
        specs.specs_over(held.withColumn("name", F.lit(None).cast("string"))).collect()


def test_grid_of_rows(spark):
    models = {"big": (2, 9.2), "small": (2, 1.2), "same": (2, 1.2), "first": (None, 7.0), "free": (1, None), "other": (3, 1.0)}
    kept = spark.createDataFrame([(n, t, p, 0) for n, (t, p) in models.items()], "name string, tier int, params_b double, place int")
    want = specs.load_models({"models": {n: {k: v for k, v in (("tier", t), ("params_b", p)) if v is not None} for n, (t, p) in sorted(models.items())}})
    assert [(r.name, r.tier, r.params_b) for r in specs.grid_over(kept).orderBy("place").collect()] == [(m.name, m.tier, m.params_b) for m in want]
    assert [r.place for r in specs.grid_over(kept, (3,)).collect()] == [0] and specs.grid_over(kept.limit(0)).count() == 0


def rows(spark, bad=()):
    data = [(lang, f"i{n}", f"q{n} ", "x", "y", None if n % 2 else "z", str(n % 2 + 1) if (lang, n) not in bad else "9", None) for lang in ("en", "fr") for n in range(100)]
    return spark.createDataFrame(data, "lang string, sample_id string, q string, a string, b string, c string, ans string, s string")


def test_load(spark):
    spec = specs.load_specs(TEXT)["exam"]
    items, manifest = benchmarks.load(rows(spark, bad={("fr", 5)}), spec)
    got = items.collect()
    assert len(got) == 6 and len({r.item_id for r in got}) == 3 and all(r.item_id != "i5" and r.strata == {"s": ""} for r in got)
    assert all(r.answer_index == int(r.item_id[1:]) % 2 and len(r.options) == 3 - int(r.item_id[1:]) % 2 for r in got)
    m = manifest.first()
    assert m.n_items == 3 and m.item_ids == sorted({r.item_id for r in got}) and m.coverage["en"].n_total == 99
    with pytest.raises(ValueError):
        benchmarks.load(rows(spark, bad={("fr", n) for n in range(5)}), spec)
    with pytest.raises(ValueError):
        benchmarks.load(rows(spark).where("lang = 'en' OR sample_id < 'i5'"), spec)


def test_probe(spark):
    p = benchmarks.probe(rows(spark).drop("c").where("lang = 'en'"), specs.load_specs(TEXT)["exam"]).first()
    assert (p.present, p.missing_languages, p.missing_columns, p.ids_ok, p.most_rows) == (["en"], ["fr"], ["c"], True, 100)


def test_scan_prunes(spark, tmp_path):
    path = str(tmp_path / "b")
    rows(spark).write.partitionBy("lang").parquet(path)
    df = benchmarks.scan(spark, path, specs.load_specs(TEXT)["story"])
    assert df.count() == 100 and "PartitionFilters: [isnotnull(lang" in df._jdf.queryExecution().toString() or "PartitionFilters: [lang" in df._jdf.queryExecution().toString()


def responses(spark):
    data = [("exam", mode, m, lang, f"i{i}", i % 2, (i % 4) - (i == 7)) for mode in ("letter", "generative") for m in ("a", "b") for lang in ("en", "fr") for i in range(8)]
    return spark.createDataFrame(data, "benchmark string, mode string, model string, language string, item_id string, correct int, predicted int").select("benchmark", "mode", "model", "language", "item_id", F.col("correct").cast("tinyint").alias("correct"), F.col("predicted").cast("smallint").alias("predicted"))


def test_shards(spark, tmp_path):
    path = str(tmp_path / "s")
    shards.write(responses(spark).where("model = 'a'"), path)
    assert shards.read(spark, path, "exam", "letter").count() == 16
    todo = outstanding(responses(spark).select(*shards.KEY).distinct(), shards.catalogue(spark, path), *shards.KEY)
    assert {r.model for r in todo.collect()} == {"b"} and todo.count() == 4


def test_archives(spark, tmp_path):
    folder = tmp_path / "exam"
    folder.mkdir()
    for name in ("m__en", "m__fr", "m__en__loglik", "m__en__generative", "broken"):
        np.savez_compressed(folder / f"{name}.npz", item_ids=np.array(["x", "y"]), correct=np.array([1, 0], np.uint8), predicted=np.array([2, -1], np.int16), meta=np.array(json.dumps({"n_items": 2, "mode_share": float("nan")})))
    letter = shards.with_meta(shards.read_archives(spark, str(tmp_path), "exam"))
    assert {(r.model, r.language) for r in letter.collect()} == {("m", "en"), ("m", "fr")} and letter.count() == 4
    assert np.isnan(letter.first().meta.mode_share) and letter.where("predicted = -1").count() == 2
    assert shards.read_archives(spark, str(tmp_path), "exam", "loglik").count() == 2
    assert shards.parse_name("only") is None and shards.parse_name("a__b__c") == ("a", "b__c", "letter")


def opened(df):
    """How many files the scan of a plan that ran took."""
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numFiles").value()


def test_archives_are_chosen_by_name(spark, tmp_path):
    folder = tmp_path / "exam"
    folder.mkdir()
    array = lambda name: np.savez_compressed(folder / name, item_ids=np.array(["x"]), correct=np.array([1], np.uint8), predicted=np.array([2], np.int16), meta=np.array("{}"))
    for model in ("m", "m%41 b+c", "n"):
        for end in ("en", "fr", "x__y", "en__loglik"):
            array(f"{model}__{end}.npz")
    for name in ("n__de.npz", "__loglik.npz", "n__.npz"):  # not archives: opening one fails, and the last two have no language
        (folder / name).write_bytes(b"broken")
    some = shards.read_archives(spark, str(tmp_path), "exam", models=["m%41 b+c", "n"], languages=["fr", "x__y"])
    assert {(r.model, r.language) for r in some.collect()} == {(m, lang) for m in ("m%41 b+c", "n") for lang in ("fr", "x__y")} and opened(some) == 4
    assert shards.read_archives(spark, str(tmp_path), "exam", "loglik").count() == 3 and shards.read_archives(spark, str(tmp_path), "exam", "generative").count() == 0
    assert shards.archive_files(spark, str(tmp_path), "exam").count() == 10
    with pytest.raises(Exception, match="n__de|pickle|broken|Cannot"):
        shards.read_archives(spark, str(tmp_path), "exam").collect()


def test_records_keep_unknown_fields(spark):
    texts = ['{"n_items": 2, "mode_share": NaN, "engine": {"name": "a NaN, \\"NaN", "tries": [1, 2]}}', '{"n_items": 3, "mode_share": 0.5, "low": -Infinity, "note": "NaN"}', "no JSON", None]
    r = shards.with_meta(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, meta string"))
    got = {x.i: x for x in r.select("i", "meta", *(shards.field("record", p, t).alias(n) for p, t, n in (("$.mode_share", "double", "share"), ("$.engine.name", "string", "name"), ("$.engine.tries[1]", "int", "tries"), ("$.low", "double", "low"), ("$.note", "string", "note")))).collect()}
    assert np.isnan(got[0].share) and np.isnan(got[0].meta.mode_share) and (got[0].name, got[0].tries, got[0].low) == ('a NaN, "NaN', 2, None)
    assert (got[1].share, got[1].low, got[1].note) == (0.5, float("-inf"), "NaN") and got[2].share is None and got[3].share is None
    names = shards.fields(r).first().fields
    assert all(x in names for x in ("engine", "tries", "low", "n_items"))


def test_whole_benchmarks_are_told_once(spark, tmp_path):
    path, out = str(tmp_path / "s"), str(tmp_path / "out")
    rows = responses(spark).where("mode = 'letter'").union(responses(spark).where("mode = 'letter'").withColumn("benchmark", F.lit("other")))
    wanted = rows.select(*shards.KEY).distinct()
    told = lambda: {(r.benchmark, r.n_shards, r.n_rows) for r in spark.read.parquet(out).collect()}

    def step(part, grid=wanted):
        shards.write(part, path)
        stream.follow_complete(spark, path, grid, str(tmp_path / "check"), out).awaitTermination()
        return sorted(r.benchmark for r in spark.read.schema("benchmark string").parquet(out).collect())

    before = spark.conf.get(stream.STATE)
    assert step(rows.where("NOT (model = 'b' AND language = 'fr')")) == []
    assert step(rows.where("benchmark = 'exam' AND model = 'a'")) == []  # written again
    assert step(rows.where("benchmark = 'exam' AND model = 'b'")) == ["exam"] and told() == {("exam", 4, 32)}  # the late shard, behind a restart
    assert step(rows.where("benchmark = 'exam'").union(rows.where("benchmark = 'exam'").withColumn("model", F.lit("unwanted")))) == ["exam"]
    more = wanted.union(wanted.where("benchmark = 'exam' AND model = 'a'").withColumn("model", F.lit("c")))
    assert step(rows.where("benchmark = 'exam' AND model = 'a'").withColumn("model", F.lit("c")), more) == ["exam", "exam"] and ("exam", 6, 48) in told()
    other = wanted.where("benchmark = 'other'")
    swapped = other.where("NOT (model = 'a' AND language = 'en')").union(other.where("model = 'b' AND language = 'fr'").withColumn("language", F.lit("de")))
    # as many shards are there as are wanted, but not the same ones
    assert step(rows.where("benchmark = 'other' AND model = 'b' AND language = 'fr'"), swapped) == ["exam", "exam"]
    assert spark.conf.get(stream.STATE) == before


def test_stream_follows_shards(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    for model in ("a", "b"):
        responses(spark).where(F.col("model") == model).coalesce(1).write.mode("append").parquet(source)
        stream.follow(spark, source, str(tmp_path / "check"), sink).awaitTermination()
    out = spark.read.parquet(sink)
    assert out.count() == 8 and out.select("batch").distinct().count() == 2
    r = out.where("model = 'a' AND mode = 'letter' AND language = 'en'").first()
    assert r.accuracy == 0.5 and r.unparseable == 0.0
    assert out.where("mode = 'generative' AND mode_share IS NOT NULL").count() == 0


def test_windowed_events(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    df = spark.read.parquet(src)
    df.coalesce(1).write.parquet(str(tmp_path / "ev"))
    q = stream.windowed_events(spark, str(tmp_path / "ev"), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)).writeStream.format("memory").queryName("win").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("win").agg(F.sum("n")).first()[0] == df.count()


def test_reports(spark):
    arms = spark.createDataFrame([("machine", 0.6), ("human", 0.3)], "arm string, drift_sd_mean double")
    assert ablations.dispersion_ratio(arms).first().ratio == pytest.approx(2.0)
    losses = spark.createDataFrame([("x", 0, "rasch", 0.6), ("x", 0, "2pl", 0.5), ("y", 0, "rasch", 0.4), ("y", 0, "2pl", 0.5)], "benchmark string, seed int, irt_model string, loss double")
    assert {r.benchmark: (r.winner, r.wins_2pl) for r in ablations.benchmark_wins(losses).collect()} == {"x": ("2pl", 1), "y": ("rasch", 1)}
    ties = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate([(1, 1), (2, 2), (2, 3), (3, 3)])], "m int, x double, y double").withColumn("g", F.lit(1))
    # of 6 pairs 4 agree, one is tied in x and one in y
    assert ablations.kendall(ties, "x", "y", ["g"]).first().tau == pytest.approx(4 / 5)


def test_scan_pins_split_and_revision(spark, tmp_path):
    path = str(tmp_path / "b")
    data = [(lang, split, rev, f"{lang}{split}{rev}") for lang in ("en", "fr", "de") for split in ("test", "eval") for rev in ("r1", "r2")]
    spark.createDataFrame(data, "lang string, split string, revision string, x string").write.partitionBy("split", "revision", "lang").parquet(path)
    spec = specs.BenchmarkSpec("b", languages=("en", "fr"), split="eval", revision="r2")
    df = benchmarks.scan(spark, path, spec)
    assert {r.x for r in df.collect()} == {"enevalr2", "frevalr2"} and {r.x for r in benchmarks.scan(spark, path, spec, ["de"]).collect()} == {"deevalr2"}
    assert {r.x for r in benchmarks.scan(spark, path, specs.BenchmarkSpec("b", languages=("en",), split="test")).collect()} == {"entestr1", "entestr2"}


def test_row_index_as_id(spark):
    spec = specs.BenchmarkSpec("b", languages=("en",), item_id_field="__row_index__", fields={"question": "q", "options": ["a", "b"], "answer": "ans", "answer_base": 0})
    df = spark.createDataFrame([("en", 30, "third", "x", "y", "1"), ("en", 10, "first", "x", "y", "0"), ("en", 20, "second", "x", "y", "0"), ("fr", 20, "un", "x", "y", "0")], "lang string, n int, q string, a string, b string, ans string").repartition(3)
    got = {(r.language, r.item_id): r.prompt.split("\n")[0] for r in benchmarks.build_items(df, spec, order="n").collect()}
    assert got == {("en", "0"): "first", ("en", "1"): "second", ("en", "2"): "third", ("fr", "0"): "un"}


# from shards to reports ------------------------------------------------------------------------------------------------
def shard_rows(spark, models="abcde", languages=("en", "fr", "de"), items=60):
    import random

    rng = random.Random(7)
    order = {lang: rng.sample(range(items), items) for lang in languages}  # rows of each language in an order of their own
    data = [("exam", "letter", m, lang, f"i{i}", int(rng.random() < 0.75 - 0.05 * languages.index(lang)), i % 4) for m in models for lang in languages for i in order[lang]]
    return spark.createDataFrame(data, "benchmark string, mode string, model string, language string, item_id string, correct byte, predicted short")


def test_assembly_gates(spark):
    rows, spec = shard_rows(spark), specs.BenchmarkSpec("exam", source_language="en")
    found = report.assemble(rows)
    assert found.status.first().asDict() == {"n_shards": 15, "n_models": 5, "n_languages": 3, "n_items": 60, "n_expected": 15} and found.missing.isEmpty()
    assert {r.mode_share for r in found.shares.collect()} == {0.25}
    with pytest.raises(ValueError, match="b/fr has other items than a/de: 1 extra, 2 missing"):
        report.assemble(rows.where("NOT (model = 'b' AND language = 'fr' AND item_id IN ('i3', 'i4'))").union(rows.where("model = 'b' AND language = 'fr' AND item_id = 'i5'").withColumn("item_id", F.lit("other"))))
    short = rows.where("NOT (model = 'c' AND language = 'de')")
    with pytest.raises(ValueError, match="exam is incomplete, without c/de"):
        report.analyse_shards(short, spec, n_boot=2)
    with pytest.raises(ValueError, match="'sw'"):
        report.analyse_shards(rows, specs.BenchmarkSpec("exam", source_language="sw"), n_boot=2)
    whole = report.completed(report.assemble(short))
    assert whole.responses.count() == 900 and whole.responses.where("model = 'c' AND language = 'de' AND correct <> 0").isEmpty()
    assert {r.mode_share for r in whole.shares.where("model = 'c' AND language = 'de'").collect()} == {1.0}
    meta = spark.createDataFrame([("a", "en", float("nan")), ("b", "en", 0.95)], "model string, language string, mode_share double")
    shares = {(r.model, r.language): r.mode_share for r in report.assemble(rows, meta).shares.collect()}
    assert np.isnan(shares["a", "en"]) and shares["b", "en"] == 0.95 and shares["c", "en"] == 0.25


@pytest.mark.parametrize("archives", [False, True])
def test_shards_to_reports(spark, tmp_path, archives):
    path, out = str(tmp_path / "s"), str(tmp_path / "out")
    rows = shard_rows(spark)
    short = rows.where("NOT (model = 'c' AND language = 'de')").withColumn("benchmark", F.lit("short"))
    if archives:
        for (b, m, lang), f in rows.union(short).toPandas().groupby(["benchmark", "model", "language"]):
            (tmp_path / "s" / b).mkdir(parents=True, exist_ok=True)
            record = {"n_items": len(f), "mode_share": 0.95 if (m, lang) == ("a", "fr") else None}
            np.savez_compressed(tmp_path / "s" / b / f"{m}__{lang}.npz", item_ids=f["item_id"].to_numpy(str), correct=f["correct"].to_numpy(), predicted=f["predicted"].to_numpy(), meta=np.array(json.dumps(record)))
        (tmp_path / "s" / "planned").mkdir()
    else:
        shards.write(rows.union(short), path)
    listed = {n: specs.BenchmarkSpec(n, hf_id="x", languages=("en",), source_language="en") for n in ("exam", "short", "planned")}
    states = {r.benchmark: (r.status, r.reason) for r in report.analyse_all(spark, path, listed, out, archives=archives, n_boot=3).collect()}
    assert states["exam"] == ("analysed", None) and states["short"][0] == "refused" and "c/de" in states["short"][1] and states["planned"] == ("skipped", "no shards")
    (one,) = spark.read.json(f"{out}/summary").collect()
    assert one.benchmark == "exam" and one.models == list("abcde") and one.languages == ["de", "en", "fr"] and [r.language for r in one.rows] == ["de", "fr"] and one.n_shards == 15
    assert [r.n_degenerate for r in one.rows] == [0, int(archives)] and spark.read.json(f"{out}/exam").count() == 1
    assert "".join(r.value for r in spark.read.text(f"{out}/tables/exam").collect()).count("\\\\") == 2
    assert {r.benchmark: r.status for r in report.analyse_all(spark, path, listed, out, names=["short"], allow_incomplete=True, archives=archives, n_boot=3).collect()} == {"short": "analysed"}


def test_a_retried_batch_is_not_written_twice(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    responses(spark).coalesce(1).write.parquet(source)
    for check in ("one", "two"):  # a lost checkpoint makes batch 0 come again
        stream.follow(spark, source, str(tmp_path / check), sink).awaitTermination()
    assert spark.read.parquet(sink).count() == 8


def test_models_that_look_like_numbers(spark, tmp_path):
    path = str(tmp_path / "s")
    shards.write(shard_rows(spark, models="12", items=2).withColumn("model", F.concat(F.lit("0"), "model")), path)
    assert {r.model for r in shards.catalogue(spark, path).collect()} == {"01", "02"}
    one = shards.read(spark, path, "exam", "letter", models=["02"], languages=["fr"])
    assert one.count() == 2 and len(one.inputFiles()) <= 6 and "PartitionFilters" in one._jdf.queryExecution().toString()
