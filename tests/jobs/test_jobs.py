"""The jobs over growing and repeated input, over runs that break off, and from the command line."""

from __future__ import annotations

import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import collect_shards as C
from jobs import mark_answers as M
from jobs import queries as J

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra int"
FIRST = [(1, "It is 4.", "en", "m1", 8, 0), (2, "rien", "fr", "m1", 4, 0), (3, None, "en", "m2", None, 0)]
SECOND = [(4, "Antwort: 1.234,5 oder", "de", "m1", 22, 0), (None, "７", None, None, 1, 0), (None, "８", None, None, 1, 0), (5, "z", "en", "m1", 1, 0), (5, "a 12", "en", "m1", 4, 0)]


@pytest.fixture
def place(tmp_path):
    return lambda name: str(tmp_path / name)


def put(spark, rows, folder, mode="append"):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode(mode).parquet(folder)


def rows(df):
    return sorted(map(str, (r.asDict() for r in df.collect())))


def take(spark, place, source="in", out="out", checkpoint="checkpoint"):
    return M.run(spark, place(source), place(out), place(checkpoint), M.read_config())


def test_answers_of_growing_input_count_once(spark, place):
    put(spark, FIRST, place("in"))
    assert take(spark, place) == {"batches": 1, "read": 3, "written": 3}
    assert take(spark, place) == {"batches": 0, "read": 0, "written": 0}
    before = rows(spark.read.parquet(place("out/answers")))
    put(spark, SECOND, place("in"))
    put(spark, FIRST[:2], place("in"))  # delivered again
    assert take(spark, place) == {"batches": 1, "read": 7, "written": 4}
    assert set(before) <= set(rows(spark.read.parquet(place("out/answers"))))
    found = {r.doc_id: r for r in M.read_back(spark, place("out")).where("doc_id IS NOT NULL").collect()}
    assert {i: (r.number, r.n_words, r.n_chars) for i, r in found.items()} == {1: (4.0, 3, 8), 2: (None, 1, 4), 3: (None, 0, 0), 4: (1234.5, 3, 21), 5: (None, 1, 1)}
    assert (found[2].unparseable, found[2].flag_unparseable, found[1].n_answers, found[1].unparseable) == (1.0, True, 2, 0.5)
    assert found[4].chars_ratio == pytest.approx(21 / 3) and found[1].mean_bytes == 4.5
    assert sorted(r.number for r in M.read_back(spark, place("out")).where("doc_id IS NULL").collect()) == [7.0, 8.0]
    put(spark, FIRST + SECOND, place("whole"))
    take(spark, place, "whole", "out2", "checkpoint2")
    assert rows(M.read_back(spark, place("out2"))) == rows(M.read_back(spark, place("out")))


@pytest.mark.parametrize("broken", ["sums", "report"])
def test_answers_after_a_run_that_broke_off(spark, place, monkeypatch, broken):
    put(spark, FIRST, place("in"))

    def fails(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(M, broken, fails)
        with pytest.raises(Exception, match="lost"):
            take(spark, place)
    put(spark, SECOND, place("in"))
    take(spark, place)
    put(spark, FIRST, place("again"))
    take(spark, place, "again", "out2", "checkpoint2")
    put(spark, SECOND, place("again"))
    take(spark, place, "again", "out2", "checkpoint2")
    assert rows(M.read_back(spark, place("out"))) == rows(M.read_back(spark, place("out2")))


def test_answers_of_an_empty_table(spark, place):
    put(spark, [], place("in"))
    assert take(spark, place)["written"] == 0


def events(spark, sf="/root/testdata/sf0.001"):
    return spark.read.parquet(f"{sf}/events.parquet")


def collect(spark, place, out="out", **change):
    return C.run(spark, place("raw"), place(out), C.read_config() | {"most_unshared": 1.0} | change)


def test_shards_of_runs_that_repeat_or_break_off(spark, place, monkeypatch):
    raw = events(spark)
    raw.where("user_id % 19 < 5").write.parquet(place("raw"))
    with monkeypatch.context() as m:  # shards are written, their markers aren't
        m.setattr(C.shards, "marks", lambda path: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            collect(spark, place)
    assert C.shards.done(spark, place("out/shards")).isEmpty()
    one = collect(spark, place)
    first = rows(C.read_back(spark, place("out")))
    assert collect(spark, place) == one and one["shards"] == 25 and one["written"] == len(first)
    assert rows(C.read_back(spark, place("out"))) == first
    assert collect(spark, place, resume=True)["shards"] == 0 and rows(C.read_back(spark, place("out"))) == first
    raw.where("user_id % 19 >= 5").write.mode("append").parquet(place("raw"))
    more = collect(spark, place, resume=True)
    collect(spark, place, out="out2")
    assert more["shards"] == 50 and C.shards.done(spark, place("out/shards")).count() == 75
    assert rows(C.read_back(spark, place("out"))) == rows(C.read_back(spark, place("out2")))


def test_shards_need_a_parallel_benchmark(spark, place):
    events(spark).where("NOT (event_type = 'click' AND event_id < 300)").write.parquet(place("raw"))
    with pytest.raises(ValueError, match="not parallel"):
        C.run(spark, place("raw"), place("out"), C.read_config())


def test_last_row_of_an_item_counts_and_nulls_are_wrong(spark):
    raw = spark.createDataFrame([("b", 1, 2, 2), ("b", 2, 1, 2), ("c", 1, None, None), ("d", 1, 3, 3)], "item string, t int, p int, a int")
    made = C.responses(raw, {"benchmark": "'x'", "mode": "'letter'", "model": "'m'", "language": "'en'", "item_id": "item", "predicted": "p", "answer": "a", "place": "t"})
    assert {(r.item_id, r.predicted, r.correct) for r in made.collect()} == {("b", 1, 0), ("c", -1, 0), ("d", 3, 1)}


@pytest.mark.parametrize("name", sorted(J.QUERIES))
def test_queries_against_duckdb(spark, sf, name):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "events"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    before = spark.sparkContext.getConf().getAll(), spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    got = J.QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    plain = lambda table: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in table), key=str)
    assert plain(map(tuple, got.select(cols).collect())) == plain(db.execute(f"SELECT {', '.join(cols)} FROM ({J.SQL[name]})").fetchall())
    assert before == (spark.sparkContext.getConf().getAll(), spark.conf.get("spark.sql.sources.partitionOverwriteMode"))


def test_command_lines(spark, sf, place):
    root = Path(__file__).resolve().parents[2]
    config = place("config.json")
    Path(config).write_text(json.dumps(C.read_config() | {"most_unshared": 1.0}))
    for args in (["jobs.mark_answers", "--source", f"{sf}/documents.parquet", "--out", place("a"), "--checkpoint", place("c")], ["jobs.collect_shards", "--source", f"{sf}/events.parquet", "--out", place("b"), "--config", config]):
        done = subprocess.run([sys.executable, "-m", *args], cwd=root, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr[-2000:]
        assert "read " in done.stderr and "wrote " in done.stderr
    assert M.read_back(spark, place("a")).count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert C.read_back(spark, place("b")).select(F.count_distinct(*C.shards.KEY)).first()[0] == 75
