"""Scoring through injected engines: one a worker, bounded batches, and runs that take up where they stopped."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftgauge.operators import panel, scores
from driftgauge.plans.scoring import score_shards
from driftgauge.sources import shards


def _telling():
    import os
    import uuid

    me = uuid.uuid4().hex

    def score(rows):
        n = rows["prompt"].fillna("").str.len()
        return pd.DataFrame({"item_id": rows["item_id"], "pid": os.getpid(), "engine": me, "batch": uuid.uuid4().hex, "rows": len(rows), "longest": int(n.max())})

    return score


def test_one_engine_a_worker_and_bounded_batches(spark):
    items = spark.range(4000).select(F.col("id").cast("string").alias("item_id"), F.when(F.col("id") % 7 > 0, F.repeat(F.lit("x"), (F.col("id") * 7919 % 500).cast("int"))).alias("prompt"), F.array(F.lit("a"), F.lit("b")).alias("options"))
    items = items.union(spark.createDataFrame([("long", "y" * 5000, ["a", "b"])], items.schema)).repartition(24)
    schema = "item_id string, pid int, engine string, batch string, rows int, longest int"
    got = scores.scored(items, _telling, schema, most_chars=4000, most_rows=50).toPandas()
    assert len(got) == 4001 and got.item_id.nunique() == 4001
    assert (got.groupby("pid").engine.nunique() == 1).all() and got.engine.nunique() <= 4 < 24
    once = got.drop_duplicates("batch")
    assert once["rows"].sum() == 4001 and (once["rows"] <= 50).all()
    assert ((once["rows"] * once.longest <= 4000) | (once["rows"] == 1)).all() and got[got.item_id == "long"]["rows"].tolist() == [1]
    other = scores.scored(items, _telling, schema).toPandas()
    assert not set(other.engine) & set(got.engine)


def test_batches():
    f = pd.DataFrame({"i": range(6)})
    cut = lambda lengths, chars, rows: [p.i.tolist() for p in scores.batches(f.iloc[: len(lengths)], pd.Series(lengths), chars, rows)]
    assert cut([9, 9, 3, 3, 3, 0], 18, 10) == [[0, 1], [2, 3, 4, 5]] and cut([50, 1, 1], 10, 10) == [[0], [1, 2]]
    assert cut([0] * 6, 1, 4) == [[0, 1, 2, 3], [4, 5]] and cut([], 5, 5) == []


class Breaks(Exception):
    pass


def _answers(wrong=""):
    def make():
        def score(rows):
            if wrong and (rows["model"] == wrong).any():
                raise ValueError("the engine broke")
            return rows.assign(predicted=rows["answer_index"].astype("int16"))[[*shards.KEY, "item_id", "predicted", "answer_index"]]

        return score

    return make


def test_a_scoring_run_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "shards")
    items = spark.range(60).select(F.lit("exam").alias("benchmark"), F.concat(F.lit("m"), (F.col("id") % 2).cast("string")).alias("model"), F.lit("en").alias("language"), F.col("id").cast("string").alias("item_id"), F.lit("q").alias("prompt"), F.array(F.lit("a"), F.lit("b")).alias("options"), (F.col("id") % 3 - 1).cast("int").alias("answer_index"))
    assert score_shards(items.where("model = 'm0'"), path, _answers()) == (1, 30)
    with pytest.raises(Exception, match="engine broke"):
        score_shards(items, path, _answers("m1"))
    def lost(*_):
        raise Breaks

    with monkeypatch.context() as m:  # the shard's rows are written, its marker isn't
        m.setattr(shards, "marks", lambda p, f=shards.marks: (lost if shards.read(spark, p).where("model = 'm1'").count() else f)(p))
        with pytest.raises(Breaks):
            score_shards(items.where("model = 'm1'").withColumn("model", F.lit("m1")), path, _answers())
    assert shards.read(spark, path).where("model = 'm1'").count() == 30
    assert score_shards(items, path, _answers("m0")) == (1, 30)
    assert score_shards(items, path, _answers("m0")) == (0, 0)
    rows = shards.read(spark, path)
    assert rows.count() == 60 and rows.select("model", "item_id").distinct().count() == 60 and rows.where("correct = 0").count() == 0
    assert panel.outstanding(items.withColumn("mode", F.lit("letter")), shards.done(spark, path), *shards.KEY).isEmpty()


def test_token_counts(spark):
    df = spark.createDataFrame([("a b c",), ("",), (None,)], "text string")
    assert [r.n_tokens for r in scores.token_counts(df, lambda: lambda t: len(t.split())).collect()] == [3, 0, 0]
    assert scores.token_counts(df.limit(0), lambda: len).count() == 0
