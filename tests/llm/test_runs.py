"""Runs against brute force over all periods, and the query against DuckDB."""

from __future__ import annotations

import hashlib
import random

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from driftgauge.llm import queries as Q
from driftgauge.llm import runs as R


def brute(words, least=6, power=4):
    """(start, length, period): for each period, the maximal stretches of places whose word comes again a period on."""
    n, found = len(words), {}
    for q in range(1, n // power + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, power * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def plain(words, runs):
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in drop)


loops = st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=5), st.integers(1, 9)), max_size=6)


@settings(max_examples=400, deadline=None)
@given(loops)
def test_runs_of_short_texts(parts):
    words = [w.encode() for p, times in parts for w in p * times]
    assert R.runs_of(words) == brute(words)
    assert R.collapsed(words, R.runs_of(words)).decode() == plain([w.decode() for w in words], brute(words))


def test_runs_of_long_texts():
    rng = random.Random(4)
    for size in (800, 3000):
        words = []
        while len(words) < size:
            loop = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 90))]
            words += (loop * rng.randint(1, 7))[: rng.randint(1, 400)]
        words = [w.encode() for w in words]
        assert R.runs_of(words) == brute(words)


def test_mask_holds_every_run():
    assert R.overlap() == 5
    words = [b"x", *[b"a"] * 6, b"y", *[b"b", b"c"] * 4, b"z"]
    ids = [sorted(set(words)).index(w) for w in words]
    import numpy as np

    assert R.segments(np.array(ids), 5) == [(1, 7), (8, 16)]
    assert R.runs_of(words) == [(1, 6, 1), (8, 8, 2)]


def test_operator_and_its_cases(spark):
    texts = [None, "", " \t\n", "one", "a a a a a", "a a a a a a", "x " + "b c\x0b" * 5 + "y", "é é " * 6, "w " * 30000, "a a a a a a"]
    df = spark.createDataFrame([(i if i != 3 else None, t, "kept", 5) for i, t in enumerate(texts)], "doc_id long, text string, other string, runs int")
    rows = R.periodic_runs(df).collect()
    assert rows[0].asDict().keys() == {"doc_id", "other", "runs", "collapsed"}
    for r, t in zip(rows, texts, strict=True):
        words = (t or "").encode().split()
        runs = [tuple(x) for x in r.runs]
        assert runs == ([(0, 30000, 1)] if len(words) == 30000 else brute(words)) and r.other == "kept"
        assert r.collapsed == ("w" if len(words) == 30000 else plain([w.decode() for w in words], runs))
    assert rows[6].runs[0].asDict() == {"start": 1, "length": 10, "period": 2} and rows[7].runs[0].period == 1
    assert R.periodic_runs(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        R.periodic_runs(df, power=3)


def test_steepest_and_list(spark):
    cases = [[], [(0, 8, 2), (20, 12, 3), (40, 17, 4)], [(5, 9, 2), (9, 9, 2)], [(3, 10, 2), (3, 15, 3)]]
    rows = spark.createDataFrame([(i, [x for x in c]) for i, c in enumerate(cases)], f"i int, runs {R.TYPE}").select("i", R.steepest().alias("best"), R.listed().alias("listed")).orderBy("i").collect()
    assert [r.best and tuple(r.best) for r in rows] == [None, (40, 17, 4), (5, 9, 2), (3, 10, 2)]
    assert [r.listed for r in rows] == ["".join("%d,%d,%d\n" % x for x in c) for c in cases]


def test_query_against_duckdb(spark):
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = Q.op12_runs(spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(db.execute(f"SELECT {', '.join(got.columns)} FROM ({Q.oracle_sql()['op12_runs']})").fetchall())
    some = {r.doc_id: r for r in got.collect()}
    none = next(r for r in some.values() if r.n_runs == 0)
    assert (none.start, none.length, none.period, none.exponent_milli) == (None,) * 4 and none.runs_sha256 == hashlib.sha256(b"").hexdigest()
