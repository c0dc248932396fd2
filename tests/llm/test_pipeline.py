"""The pipeline's stages, each on its own input, and all of them together."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F

from driftgauge.llm import queries as Q

from .test_operators import _linked

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stages_in_order(spark, docs):
    assert [n for n, _ in P.STAGES] == ["quality classifier", "n-gram Jaccard join", "PII", "mixing", "SentencePiece"] and P.ORACLE_SQL is None
    for _, f in P.STAGES[:-1]:
        assert f(spark, docs, SF).columns == P.COLUMNS
        assert f(spark, docs.limit(0), SF).count() == 0


def test_quality_stage(spark, docs):
    kept = {r.doc_id for r in P.quality_stage(spark, docs, SF).select("doc_id").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good, bad = [i for i, q in labels.items() if q], [i for i, q in labels.items() if not q]
    assert sum(i in kept for i in good) > 0.97 * len(good) and sum(i in kept for i in bad) < 0.05 * len(bad)


def test_near_duplicates_stage(spark, docs):
    kept = {r.doc_id for r in P.near_duplicates_stage(spark, docs, SF).select("doc_id").collect()}
    assert kept == {c for _, c in _linked([(r.doc_id, r.text) for r in docs.collect()], 5, 80, 100).values()}


def test_near_duplicates_of_odd_ids(spark):
    one, other, third, fourth = (" ".join(f"{x}{i}" for i in range(100)) for x in "abcd")
    ids = [(1, one), (1, one), (1, other), (None, one), (None, third), (None, third), (2, one + " more"), (3, fourth), (3, one), (3, ""), (3, None), (5, other)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in ids]
    want = Counter([(1, one), (1, other), (None, third), (3, fourth), (3, ""), (3, None)])
    for n in (1, 5):
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(n)
        assert Counter((r.doc_id, r.text) for r in P.near_duplicates_stage(spark, df, SF).collect()) == want


def test_private_stage(spark, docs):
    was, now = ({r.doc_id: r for r in d.collect()} for d in (docs, P.private_stage(spark, docs, SF)))
    assert set(was) == set(now) and all(len(r.text) == r.n_chars for r in now.values())
    clean = [i for i, r in was.items() if not any(c in "0123456789@" for c in r.text)]
    assert len(clean) > 500 and all(now[i].text == was[i].text for i in clean) and any(now[i].text != was[i].text for i in was)


ODD = [
    (1, None, "en", "a", None), (2, "", "en", None, 0), (3, " \n", None, "a", 2), (4, "word " * 20_000, "en", "a", 100_000), (5, "x" * 60_000, "en", "b", 60_000), (6, "a plain line of text\nand one more line here", "en", "b", 44),
    (6, "a plain line of text\nand one more line here", "en", "b", 44), (6, "another text under the same id, with other words", "en", "b", 48), (None, "no id stands here, but words do", "de", None, 31), (7, "Card 4111 1111 1111 1111 and mail jane@example.com", None, None, 50),
]


@pytest.mark.parametrize("n", [1, 4])
def test_stages_on_odd_rows(spark, n):
    clash = "score string, ids string, bin string, row string, component_id string, id string, size string, repeats string"
    df = spark.createDataFrame([(*r, *"xxxxxxxx") for r in ODD], f"doc_id long, text string, lang string, source string, n_chars long, {clash}").repartition(n)
    rows = lambda d: Counter((r.doc_id, r.text) for r in d.collect())
    every = Counter((r[0], r[1]) for r in ODD)
    outs = {name: f(spark, df, SF) for name, f in P.STAGES}
    assert all(d.columns == P.COLUMNS for name, d in outs.items() if name != "SentencePiece")
    kept = rows(outs["quality classifier"])
    assert kept <= every and len({kept[x] == every[x] for x in every if not (x[1] or "").strip()}) == 1  # texts without lines go together
    assert rows(outs["n-gram Jaccard join"]) == every - Counter([(6, ODD[5][1])])
    now = {r.doc_id: r for r in outs["PII"].collect()}
    assert sum(rows(outs["PII"]).values()) == len(ODD) and now[1].text is None and now[1].n_chars is None and now[2].text == "" and now[4].text == ODD[3][1]
    assert now[7].text != ODD[-1][1] and len(now[7].text) == now[7].n_chars == 50 and now[7].text.startswith("Card ") and now[7].text.endswith("@example.com")
    mixed = rows(outs["mixing"])
    assert set(mixed) <= {(i, t) for i, t in every if (t or "").strip()} and all(c <= 2 * every[x] for x, c in mixed.items())
    coded = outs["SentencePiece"].collect()
    assert Counter((r.doc_id, r.text) for r in coded) == every and all((len(r.ids) > 0) == bool(r.text) for r in coded)


def test_run(spark):
    out = P.run(spark, SF)
    left = {f.split("/pipeline-")[1].split("/")[1] for f in out.inputFiles()}
    folder = Path(out.inputFiles()[0].removeprefix("file:")).parent.parent
    assert left == {"4"} and sorted(x.name for x in folder.iterdir() if x.is_dir()) == ["4"]
    assert out.columns == [*P.COLUMNS, "ids"] and out.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    words = out.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    kept = P.near_duplicates_stage(spark, P.quality_stage(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF), SF)
    assert abs(words / (1.5 * kept.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]) - 1) < 0.02
    assert set(Q.queries()) >= {f"op{n}_{x}" for n, x in enumerate(["chat", "quality", "jaccard", "tokens", "mpeg", "pieces", "mixing", "urls", "pii", "sketch"], 1)} | {"pipeline"}
