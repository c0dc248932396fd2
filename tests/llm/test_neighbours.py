"""The graph search against brute force: recall, exact scores, ties, hot vectors and rows that take no part."""

from __future__ import annotations

import math

import numpy as np
import pytest

from driftgauge.llm import neighbours as N
from driftgauge.llm import queries as Q

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, queries, k):
    """{query id: [(id, score), ...]} in double precision; rows that share the query's id don't count."""
    fine = lambda v: v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    kept = sorted({(i, tuple(v)) for i, v in rows if i is not None and fine(v)})
    out = {}
    for i, v in sorted({(i, tuple(v)) for i, v in queries if i is not None and fine(v)}):
        scored = [(-float((np.array(w, float) * np.array(v, float)).sum()), j) for j, w in kept if j != i and len(w) == len(v)]
        out[i] = [(j, -s) for s, j in sorted(scored)[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r["rank"]
    return out


def test_the_query_finds_nearly_all_and_scores_exactly(spark):
    sf = "/root/testdata/sf0.1"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want, got = brute(rows, [r for r in rows if r[0] % 20 == 0], 20), found(Q.op11_hnsw(spark, sf))
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    hits = [len({j for j, _ in got[i]} & {j for j, _ in want[i]}) / 20 for i in want]
    assert np.mean(hits) >= 0.97
    vectors = {i: np.array(v, float) for i, v in rows}
    for i, best in got.items():
        assert all(s == pytest.approx(float(vectors[i] @ vectors[j]), abs=1e-12) for j, s in best)
        assert best == sorted(best, key=lambda x: (-x[1], x[0]))


def test_one_shard_of_more_levels_finds_nearly_all():
    x = np.random.default_rng(5).normal(size=(6000, 24)) * np.random.default_rng(6).uniform(0.3, 3, (6000, 1))  # lengths differ: inner products, not angles
    sizes, tables = N.build_graph(N._lifted(x))
    assert sizes == [6000, 375, 24, 2] and [t.shape for t in tables] == [(6000, 32), (375, 16), (24, 16), (2, 16)]
    assert all(len(set(r[r >= 0])) == (r >= 0).sum() and i not in r for i, r in enumerate(tables[0]))
    graph = N.Graph(np.arange(6000), np.arange(6001), x, sizes, np.concatenate([t.ravel() for t in tables]))
    q = x[:200]
    row, vec, score = graph.search(q, np.arange(200), 20, 128)
    true = q @ x.T
    true[np.arange(200), np.arange(200)] = -np.inf
    best = np.argsort(-true, 1)[:, :20]
    assert np.mean([len(set(vec[row == i]) & set(best[i])) / 20 for i in range(200)]) >= 0.95


def test_ties_hot_vectors_and_rows_that_take_no_part(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=4).astype(np.float32)]) for i in range(60)]
    rows += [(i, [1.0, 0.0, 0.0, 0.0]) for i in range(100, 160)] + [(7, [9.0, 0.0, 0.0, 0.0]), rows[3], rows[3]]  # a hot vector, an id that has two, repeated rows
    rows += [(200, None), (201, []), (202, [0.0] * 4), (203, [1.0, None, 0.0, 0.0]), (204, [float("nan"), 1.0, 0.0, 0.0]), (205, [float("inf"), 1.0, 0.0, 0.0]), (None, [1.0, 2.0, 3.0, 4.0])]
    rows += [(300, [1.0, 2.0]), (301, [3.0, 1.0]), (302, [5.0])]  # other lengths
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("vec_id", "embedding", "'x' AS rank", "1 AS score", "2 AS dim", "3 AS vector", "4 AS shard")
    queries = [r for r in rows if r[0] in (0, 3, 20, 100, 140, 200, 202, 203, 300, 302)]
    got = found(N.search(df, df.where("vec_id IN (0, 3, 20, 100, 140, 200, 202, 203, 300, 302)"), k=20))
    want = {i: v for i, v in brute(rows, queries, 20).items() if v}
    assert {i: [j for j, _ in v] for i, v in got.items()} == {i: [j for j, _ in v] for i, v in want.items()}
    assert 302 not in got and [j for j, _ in got[300]] == [301]
    same = [j for j, s in got[100] if s == 1.0]
    assert same == list(range(101, 101 + len(same))) and same  # equal scores: least ids


def test_queries_of_one_id_with_two_vectors(spark):
    df = spark.createDataFrame([(7, [1.0, 0.0]), (7, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [0.1, 1.0])], SCHEMA)
    got = [tuple(r) for r in N.search(df, df.where("vec_id = 7"), k=1).collect()]
    assert sorted(r[:3] for r in got) == [(7, 1, 1), (7, 1, 2)]


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([(1, [1.0])], SCHEMA)
    assert N.search(df, df).collect() == N.search(one, one).collect() == N.search(one, df).collect() == N.search(df, one).collect() == []
    with pytest.raises(ValueError):
        N.search(df, df, k=0)
