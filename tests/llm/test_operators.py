"""The training-data operators against brute force, the public libraries, exact round trips and held-out labels, with odd rows of every kind."""

from __future__ import annotations

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftgauge.llm import _common, chat, components, jaccard, mixing, mpeg, pieces, pii, quality, shingles, sketch, tokencount, urls
from driftgauge.llm import queries as Q

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, bin string, id string, tokens string, score string"
#: null, empty, blank, very long, repeated and tied rows; columns whose names the operators use inside
ODD = [
    (0, None, "en", "a", None), (1, "", "en", "a", 0), (2, " \n\t ", "en", None, 4), (3, "one", "en", "a", 3), (4, "one", "en", "b", 3), (4, "one", "en", "b", 3), (5, "a b c d e f g h", None, "b", 15),
    (6, "A b\x0bc d e f g H", "en", None, 15), (7, "word " * 30_000, "en", "c", 150_000), (8, "x" * 100_000, "en", "c", 100_000), (9, "naïve ünïcode 漢字 😀 line\nnext", "de", "a", 28), (10, "\n".join("line of some words here" for _ in range(50)), "en", "a", None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in ODD], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# 1 -----------------------------------------------------------------------------------------------------------------
def _chats(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat_round_trip(spark, sf):
    own = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"), (-8, 5, "us\\er\n[/INST]", "a\\<s>\\\\[/INST] <<SYS>>\\n </s"), (-9, None, None, None), (None, 1, "assistant", "x"), (-10, 1, "assistant", ""), (-10, 1, "assistant", ""), (-11, 0, "user", "<" * 5000 + "</s>" * 3000)]
    odd = spark.createDataFrame(own, "conv_id long, turn long, role string, text string")
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").union(odd).withColumn("turns", F.lit("x")).withColumn("goal", F.lit(1))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(chat.prefix_target_examples(rows)).collect()}
    assert got == _chats([tuple(r)[:4] for r in rows.collect()])


def test_chat_examples(spark):
    rows = spark.createDataFrame([(1, i, r, f"t{i}") for i, r in enumerate(["system", "user", "assistant", "user", "assistant", "user"])], "conv_id long, turn long, role string, text string")
    ex = chat.prefix_target_examples(rows).orderBy("example").collect()
    assert [(e.target, e.is_last) for e in ex] == [(2, False), (4, False), (None, True)]
    assert ex[1].formatted.startswith(ex[0].formatted) and ex[0].formatted[ex[0].loss_start :][: ex[0].loss_length] == "t2"
    assert chat.read_back(chat.prefix_target_examples(rows.limit(0))).count() == 0


def test_chat_against_duckdb(spark, sf):
    import duckdb

    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    rows = db.execute(Q.oracle_sql()["op1_chat"]).fetchall()
    assert sorted(rows) == sorted(tuple(r) for r in Q.op1_chat(spark, sf).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars").collect())


# 2 -----------------------------------------------------------------------------------------------------------------
def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in Q.op2_quality(spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([r.predicted == labels[r.doc_id] for r in rows]) > 0.95


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(0)
    u, s = rng.normal(size=6), rng.normal(size=(2, 2))
    total, good = 0.0, np.zeros(6)
    for path in np.ndindex(*(2,) * 6):
        w = np.exp(sum(u[i] for i, y in enumerate(path) if y) + sum(s[a, b] for a, b in zip(path, path[1:], strict=False)))
        total += w
        good += w * np.array(path)
    assert np.allclose(quality.marginals(u.tolist(), s), good / total)


def test_quality_odd(spark, odd, empty):
    labels = spark.createDataFrame([(3, 1), (9, 1), (7, 0), (8, 0), (8, 0), (5, 1), (5, 0), (10, None), (None, 1)], "doc_id long, quality int")
    model = quality.train(odd, labels)
    scored = quality.score(odd, model).collect()
    assert len(scored) == len(ODD) and all(0 <= r.score <= 1 for r in scored)
    assert {r.score for r in scored if r.doc_id in (0, 1, 2)} == {model.prior}
    assert quality.score(empty, quality.train(empty, labels.limit(0))).count() == 0
    assert quality.train(odd, labels.limit(0)).prior == 0.5
    one, many = (quality.score_batch([x], model)[0] for x in ("a b\nc d", "e f")), quality.score_batch(["a b\nc d", "", "e f"], model)
    assert np.allclose(list(one), [many[0], many[2]])


def _chained(unary, switch):
    """Marginals of good by sums over logs of both messages."""
    n, logs = len(unary), np.logaddexp
    f, b = np.zeros((n, 2)), np.zeros((n, 2))
    for i in range(n):
        own = np.array([0.0, np.clip(unary[i], -30, 30)])
        f[i] = own + (logs(f[i - 1, 0] + switch[0], f[i - 1, 1] + switch[1]) if i else 0)
    for i in range(n - 2, -1, -1):
        nxt = b[i + 1] + np.array([0.0, np.clip(unary[i + 1], -30, 30)])
        b[i] = [logs(*(switch[s] + nxt)) for s in (0, 1)]
    t = f + b
    return np.exp(t[:, 1] - logs(t[:, 0], t[:, 1]))


def test_quality_query_against_a_plain_version(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    model, got = quality.train(docs, labels), {r.doc_id: r for r in Q.op2_quality(spark, sf).collect()}
    assert model.link != (0.0, 0.0) and len(got) == docs.count()
    for r in docs.collect():
        lines = [x for x in (r.text or "").split("\n") if x.strip()]
        want, p = model.prior, np.zeros(0)
        if lines:
            own, size = quality.own_features(lines)
            x = np.zeros((len(lines), quality.WIDTH))
            for i in range(len(lines)):
                x[i] = [*own[i], *(own[i - 1] if i else 0 * own[0]), *(own[i + 1] if i + 1 < len(lines) else 0 * own[0]), i > 0, i + 1 < len(lines), 1]
            p = _chained(x @ model.weights, model.switch)
            want = 1 / (1 + np.exp(-model.link[0] - model.link[1] * (p * size).sum() / sum(len(t.encode()) for t in lines)))
        g = got[r.doc_id]
        assert g.score == pytest.approx(want, abs=1e-9) and g.predicted == (g.score >= 0.5) and g.n_lines == len(lines)
        assert g.n_good_lines in {int((p >= 0.5 + e).sum()) for e in (-1e-6, 0, 1e-6)}


def test_quality_learns_where_lines_differ(spark):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice("the river runs past old houses and then a quiet mill stands near many green trees".split()) for _ in range(rng.randrange(9, 16))) + "."
    bad = lambda: "$$$ " + " ".join(rng.choice(["BUY", "NOW!!!", "###", "WIN", "$$$", "!!!"]) for _ in range(rng.randrange(3, 7)))
    rows = []
    for i in range(300):
        kinds = [i % 2] * 9
        if i % 3 == 0:
            kinds[3 : 6 if i % 2 else 4] = [1 - i % 2] * (3 if i % 2 else 1)  # some lines of the other kind, the lesser part of the length
        rows.append((i, "\n".join(good() if k else bad() for k in kinds), kinds))
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    model = quality.train(df, labels)
    out = quality.score(df, model, lines="l").where("doc_id >= 200").collect()
    right = [(x.good >= 0.5) == bool(k) for r in out for x, k in zip(r.l, rows[r.doc_id][2], strict=True)]
    assert np.mean(right) > 0.95 and all((r.score >= 0.5) == bool(r.doc_id % 2) for r in out)
    lines = {r.doc_id: [x.n_bytes for x in r.l] for r in out}
    assert all(lines[i] == [len(t) for t in text.split("\n")] for i, text, _ in rows[200:])


def test_quality_sample_is_bounded_and_repeatable(spark):
    rows = [(i % 40, f"line {i} of text\n" * (1 + i % 5) + ("!!! $$$ ###\n" if i % 2 else "and words")) for i in range(120)] + [(100, "x\n" * 5000)]
    df, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(40)] + [(100, 1)], "doc_id long, quality int")
    a, b = quality.train(df, labels), quality.train(df.orderBy(F.desc("text")).repartition(5), labels)
    assert np.allclose(a.weights, b.weights) and a.link == pytest.approx(b.link)
    few = quality.train(df, labels, max_lines=60)
    assert not np.allclose(a.weights, few.weights) and quality.train(df, labels, max_lines=0).link == (0.0, 0.0)


# 3 -----------------------------------------------------------------------------------------------------------------
def _set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def _linked(rows, k, num, den):
    sets, at = {}, defaultdict(list)
    for i, t in rows:
        sets[i] = _set(t, k)
    for i, s in sets.items():
        for x in s:
            at[x].append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in at[x] if j < i).items():
            if n * den >= num * (len(s) + len(sets[j]) - n) and (a := find(i)) != (b := find(j)):
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def _edited(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**9)}"
    return " ".join(w)


@pytest.mark.parametrize(("k", "num", "scale"), [(3, 90, False), (5, 80, False), (5, 80, True)])
def test_jaccard_against_brute_force(spark, monkeypatch, k, num, scale):
    if scale:  # as on data beyond every bound: filters pass all, keys, tokens and heads are hot, tables aren't broadcast whole
        for module in (_common, jaccard):
            monkeypatch.setattr(module, "HOT_KEYS", 20)
        monkeypatch.setattr(_common, "LEAST_HOT", 5)
        monkeypatch.setattr(jaccard, "FILTER_BITS", (5, 5))
        monkeypatch.setattr(jaccard, "MOST_HITS", 20)
        monkeypatch.setattr(jaccard, "ROWS", 64)
    rng = random.Random(k)
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    rows = [(i, _edited(rng, base, rng.randrange(6))) for i in range(400)]  # a large group about as far apart as the threshold
    rows += [(1000 + i, " ".join(f"v{rng.randrange(50_000)}" for _ in range(rng.randrange(1, 80))) + " this common line stands in all of these texts") for i in range(150)]
    rows += [(2000 + i, " ".join(base[: 100 + i])) for i in range(50)]  # a chain of growing texts
    rows += [(3000 + i, t) for i, t in enumerate([None, "", "one", "One", "one two", "one two three", " one  two\x0bthree"])]
    rows += [(4000 + i, "the same text in each of these documents") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, k, num, 100).collect()}
    assert got == _linked(rows, k, num, 100)


@pytest.mark.parametrize("hot", [False, True])
def test_matched(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(_common, "LEAST_HOT", 5)
        monkeypatch.setattr(_common, "HOT_KEYS", 3)
    rows = spark.createDataFrame([(min(i, 30) % 13 if i < 60 else 99, i) for i in range(200)], "k long, v long")
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("c"), F.max("v").alias("m")).where("k <> 4")
    assert sorted(map(tuple, _common.matched(rows, table, ["k"], 200).collect())) == sorted(map(tuple, rows.join(table, "k").collect()))


def test_checkpoints_need_a_shared_folder():
    class Context:
        master = "spark://cluster:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        _common.shared_folder(Context())


def test_jaccard_odd(spark, odd, empty):
    got = jaccard.jaccard_components(odd.union(odd.limit(1).withColumn("doc_id", F.lit(None).cast("long"))), 3, 90, 100).collect()
    by = {r.doc_id: (r.n_shingles, r.component_id) for r in got}
    assert len(got) == len(ODD) + 1 and by[0] == (0, 0) and by[1] == (0, 1) and by[4] == (1, 3) and by[6] == (6, 5) and by[None] == (0, None)
    assert jaccard.jaccard_components(empty).count() == 0
    with pytest.raises(ValueError):
        jaccard.jaccard_components(empty, num=0)


def test_shingles_are_sets_of_words():
    texts = ["", "a", "A b", "A b c A b c", "é É x\x0by", "a b c"]
    got = shingles.sets(pa.array(["zz", *texts])[1:], 3)
    assert [len(s) for s in got] == [len(_set(t, 3)) for t in texts] and set(got[5]) < set(got[3])


@pytest.mark.parametrize("hot", [False, True])
def test_components(spark, monkeypatch, hot):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    edges += [(5000, 5001 + i) for i in range(200)] + [(5001 + i, 6000 + i) for i in range(40)]  # a star
    if hot:
        monkeypatch.setattr(_common, "LEAST_HOT", 5)
        monkeypatch.setattr(_common, "HOT_KEYS", 3)
    got = {r.node: r.component for r in components.components(spark.createDataFrame([*edges, (None, 1), (1, None)], "a long, b long")).collect()}
    root = {}
    find = lambda x: x if root.get(x, x) == x else find(root[x])
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


# 4 -----------------------------------------------------------------------------------------------------------------
def test_tokens_against_library(spark, docs, odd, empty):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    path = Q.tokenizer("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    more = ["<|endoftext|> a<|endoftext|><|endoftext|>b <|endof", "日本語 1234 ٣٤ x  \n\n y", "don't I'LL  ", "\u00a0\u2003x\u200b"]
    df = docs.select("doc_id", "text").union(odd.select("doc_id", "text")).union(spark.createDataFrame(list(enumerate(more)), "doc_id long, text string"))
    want = sorted((r.doc_id, len((r.text or "").encode()), len(lib.encode(r.text or "", add_special_tokens=False).ids)) for r in df.collect())
    assert sorted(tuple(r) for r in tokencount.count_tokens(df.withColumn("n_tokens", F.lit(0)), path).collect()) == want
    assert tokencount.count_tokens(empty, path).count() == 0


def test_whole_tokens_are_proven():
    assert tokencount.prove({"ab": 0, "abc": 1, "bc": 2, "a": 3}, [("b", "c"), ("a", "b")]) == ["ab", "bc", "a"]
    with pytest.raises(ValueError):
        tokencount.Counter(Q.tokenizer("word_bpe_49k.json"))


# 5 -----------------------------------------------------------------------------------------------------------------
def test_mpeg_round_trip(odd, docs, empty):
    for r in mpeg.probe(mpeg.store(docs.select("doc_id", "text").union(odd.select("doc_id", "text")))).collect():
        s = mpeg.scan(r.media)
        assert len(r.payload) % 576 == 0 and len(r.payload) >= 576 and set(r.payload[r.n_bytes :]) <= {255}
        assert (r.frames, r.samples, r.rate) == (len(r.payload) // 576, len(r.payload) * 2, 48000) and r.table_ok and r.crc_ok == r.frames + 1 and not r.crc_bad + r.resyncs + r.junk_bytes
        assert r.tags == ["ID3v1", "ID3v2.4"] and all(r.media[o : o + 2] == b"\xff\xfa" for o in r.frame_offsets) and s.seek(1152) == s.offsets[min(1, s.frames - 1)]
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    got = {r.doc_id: r.payload[: r.n_bytes].decode() for r in mpeg.probe(mpeg.store(odd)).collect()}
    assert got == texts and mpeg.probe(mpeg.store(empty)).count() == 0


def test_mpeg_streams_of_others():
    frames = [mpeg._frame(k, os.urandom(4)) for k in (32, 64, 320, 128, 224) * 6]
    s = mpeg.scan(b"".join(frames))
    assert s.variable and s.frames == 30 and s.seconds == 30 * 1152 / 48000 and s.sizes == [len(f) for f in frames]
    s = mpeg.scan(b"junk\xff\xfb\x00" + b"".join(frames[:9]) + b"\xff\xff\xffgarbage\xff" + b"".join(frames[9:]) + b"\xff\xfa")
    assert (s.frames, s.resyncs, s.crc_ok) == (30, 2, 30) and s.junk == 7 + 11 + 2
    bad = bytearray(b"".join(frames))
    bad[len(frames[0]) + 8] ^= 1
    assert (mpeg.scan(bytes(bad)).crc_bad, mpeg.scan(bytes(bad)).frames) == (1, 30)
    vbri = bytearray(mpeg._frame(128, b""))
    vbri[36:40], vbri[50:54], vbri[46:50] = b"VBRI", (30).to_bytes(4, "big"), (len(vbri) + sum(map(len, frames))).to_bytes(4, "big")
    s = mpeg.scan(bytes(vbri) + b"".join(frames))
    assert (s.table, s.table_frames, s.table_ok, s.frames) == ("VBRI", 30, True, 30)
    assert mpeg.scan(b"").frames == 0 and mpeg.scan(os.urandom(3000)).frames <= 2
    with pytest.raises(ValueError):
        mpeg.pack(b"")


# 6 -----------------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def model():
    return pieces.load(Q.tokenizer("piece_bpe_32k.model"))


def test_pieces_against_library(model, docs, odd):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(open(Q.tokenizer("piece_bpe_32k.model"), "rb").read())
    m.trainer_spec.model_type = 1  # the same pieces and scores as a unigram model
    for p, s in zip(m.pieces, model.scores, strict=True):
        p.score = float(s)
    lib = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    texts = [r.text or "" for r in docs.select("text").union(odd.select("text")).collect()] + ["  a  b ", "<s>hi</s>", "▁x", "a\0b"]
    texts = [t for t in texts if len(t) < 10_000]  # the library adds up longer paths in single precision
    got = model.encode(texts)
    assert all(lib.encode(t) == g.tolist() for t, g in zip(texts, got, strict=True))
    assert all(lib.decode(g.tolist()) == model.decode(g) for g in got)


def test_pieces_round_trip(spark, model, odd, empty):
    rows = pieces.decode(pieces.encode(odd, model), model).collect()
    assert len(rows) == len(ODD) and all(r.decoded == (r.text or "") for r in rows)
    assert pieces.decode(pieces.encode(empty, model), model).count() == 0
    none = spark.createDataFrame([(None,)], "ids array<int>")
    assert pieces.decode(none, model).first().decoded == ""


def test_pieces_forget(model, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 5)
    fresh = pieces.load(Q.tokenizer("piece_bpe_32k.model"))
    texts = ["some words and more words", "other words then", "x" * 300, ""] * 3
    assert all((a == b).all() for a, b in zip(fresh.encode(texts), model.encode(texts), strict=True))


def test_double_array():
    words = {"a": 0, "ab": 1, "abc": 2, "b": 3, "bcd": 4}
    code = {c: i for i, c in enumerate("abcd", 1)}
    base, check, value = pieces.double_array(words, code)
    for w in ["a", "ab", "abc", "b", "bc", "bcd", "c", "abd"]:
        at = 0
        for c in w:
            nxt = base[at] + code[c]
            at = nxt if at is not None and base[at] and check[nxt] == at else None
            if at is None:
                break
        assert (value[at] if at is not None else -1) == words.get(w, -1)


# 7 -----------------------------------------------------------------------------------------------------------------
def _fill(sizes, weights, budget, cap):
    left, rest, out = budget * sum(sizes.values()), set(sizes), {}
    while rest:
        w = sum(weights[s] for s in rest)
        over = {s for s in rest if left * weights[s] / w > cap * sizes[s]} if w else set()
        if not over:
            return out | {s: left * weights[s] / w if w else 0.0 for s in rest}
        for s in over:
            out[s] = cap * sizes[s]
        left -= sum(out[s] for s in over)
        rest -= over
    return out


def test_mixing(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    a, b = (sorted(tuple(r) for r in mixing.mix(d, [5, 2, 1], 1.5, 2.0, 3).collect()) for d in (df, df.repartition(5)))
    assert a == b
    source = {r.doc_id: r.source for r in df.collect()}
    size, taken, target = Counter(), Counter(), {}
    for i, n, whole, t, _, k in a:
        assert k <= 2 * n
        size[source[i]] += n
        taken[source[i]] += k
        target[source[i]] = t
    want = _fill(size, {s: [5, 2, 1][j % 3] for j, s in enumerate(sorted(size))}, 1.5, 2)
    assert all(abs(target[s] - want[s]) < 1e-6 for s in size) and all(abs(taken[s] / target[s] - 1) < 0.05 for s in size)
    assert all(n == len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for (i, n, *_), t in zip(a, [r.text for r in df.orderBy("doc_id").collect()], strict=True))


@pytest.mark.parametrize(
    ("sizes", "weights", "budget"),
    [([100, 100], [1.0], 1.5), ([500, 200], [5.0, 2.0], 1.5), ([100] * 6, [5.0, 2.0, 1.0], 1.5), ([100] * 9, [5.0, 2.0, 1.0], 1.5), ([300, 300, 0, 40], [5.0, 2.0, 0.0, 5.0], 1.0), ([100] * 3, [1.0], 2.0), ([70, 100, 100, 900], [1.0], 1.7)],
)
def test_mixing_targets_of_ties(spark, sizes, weights, budget):
    size = {f"s{i}": n for i, n in enumerate(sizes)}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(size.items()), "source string, source_size long"), weights, budget, 2.0).collect()}
    assert got == pytest.approx(_fill(size, {x: weights[i % len(weights)] for i, x in enumerate(size)}, budget, 2.0))


def test_mixing_odd(odd, empty):
    rows = mixing.mix(odd, [5, 2, 1], 1.5, 2.0, keep=["text"]).collect()
    assert len(rows) == len(ODD) and all(r.taken == r.repeats * r.size and r.taken <= 2 * r.size for r in rows) and {r.size for r in rows if r.doc_id in (0, 1, 2)} == {0}
    assert mixing.mix(empty, [1.0]).count() == 0
    assert all(r.target == 2 * r.source_size for r in mixing.mix(odd, [1.0], budget=9.0).collect())
    assert all(r.taken == 0 for r in mixing.mix(odd, [0.0]).collect())


# 8 -----------------------------------------------------------------------------------------------------------------
def test_urls(spark):
    rows = [
        ("https://A.Example.ORG/es/1?x#y", "a.example.org", "/es/1", "example.org/es/", "block"), ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"), ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
        ("http://badexample.org", "badexample.org", "", None, None), ("http://x.com/fr/", "x.com", "/fr/", "com/fr/", "allow"), ("http://x.com/de/", "x.com", "/de/", "com/de/", "block"), ("nothing", "", "", None, None), (None, "", "", None, None), ("a://b?c/d", "b", "", None, None),
        ("https://www.casino.net/terms", "www.casino.net", "/terms", None, "block"), ("https://www.bakery.net/terms", "www.bakery.net", "/terms", None, "allow"), ("ftp://h\n/p\nq", "h\n", "/p\nq", None, None),
    ]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "page_id long, url string").withColumn("host", F.lit("x")).withColumn("z", F.lit(1))
    got = {r.page_id: r for r in urls.judge(df, Q.RULES, keep=["page_id"]).collect()}
    weights, bias = urls.train()
    for i, (_, host, path, rule, verdict) in enumerate(rows):
        z = bias + sum(weights[g] for g in urls._grams([ord(c) for c in f"^{host}{path}$"]))
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule) and got[i].verdict == (verdict or ("block" if z >= 0 else "allow"))
        assert rule or got[i].verdict == ("block" if z >= 0 else "allow")
    assert urls.judge(df.limit(0), Q.RULES).count() == 0 and urls.train(())[1] < 0
    with pytest.raises(ValueError):
        urls.train(tuple(("x", 1) for _ in range(urls.MOST_ROWS + 1)))


#: Written down before the model was fitted; none is in its table.
ORDINARY = """bakery airline orchard theater insurance gazette veterinary plywood aquarium notary choir bookstore pottery tourism accounting meteorology kindergarten brewery logistics seafood
    parish botanic stationery rugby linguistics carpentry hardware geology wedding florist translation dairy knitting observatory cardiology recycling upholstery philharmonic vineyard surveyor""".split()
SPAM = """casinos megaslots pokerstars betting bet-now jackpots hotporn sexcams xxxvideos nudes viagra-online cheapcialis steroid-shop paydayloan cash-loans get-rich-fast lotto torrents crackz warez-zone
    phish malwares spam-links linkfarms popad replica-bags fakewatches freegiveaway escort-girls weightloss""".split()


def test_urls_model_on_words_and_places_not_in_its_table():
    known, table = set(urls.BLOCKED + urls.ALLOWED), urls.labelled()
    assert not known & set(ORDINARY + SPAM) and not set(urls.BLOCKED) & set(urls.ALLOWED) and len(table) < urls.MOST_ROWS

    def blocked(held, train=None):
        w, b = urls.train(train and tuple(train))
        return np.mean([b + sum(w[g] for g in urls._grams([ord(c) for c in f"^{t}$"])) >= 0 for t, _ in held])

    assert blocked(urls.labelled(SPAM, [])) > 0.65 and blocked(urls.labelled([], ORDINARY)) < 0.04
    n = len(urls.PLACES)
    rest = [[r for i, r in enumerate(table) if i % n != j] for j in range(n)]
    held = [table[j::n] for j in range(n)]
    assert np.mean([blocked([r for r in h if r[1]], t) for h, t in zip(held, rest, strict=True)]) > 0.8
    assert np.mean([blocked([r for r in h if not r[1]], t) for h, t in zip(held, rest, strict=True)]) < 0.01


def test_urls_against_duckdb(spark, sf):
    import duckdb

    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    a = sorted(tuple(map(str, r)) for r in Q.op8_urls(spark, sf).select("page_id", "host", "path", "rule", "verdict").collect())
    assert a == sorted(tuple(map(str, r)) for r in db.execute(Q.oracle_sql()["op8_urls"]).fetchall())


# 9 -----------------------------------------------------------------------------------------------------------------
PRIVATE = [
    ("4111 1111 1111 1111", "card"), ("4111111111111111", "card"), ("+1 (017) 555-7713", "phone"), ("(017) 555-7713", "phone"), ("2024-02-29", "date"), ("29.02.2024", "date"), ("12/31/1999", "date"), ("078-05-1120", "ssn"),
    ("DE89 3704 0044 0532 0130 00", "iban"), ("DE89370400440532013000", "iban"), ("192.168.17.254", "ip"), ("ana.b77@mail1.example.com", "email"), ('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "secret"),
]


@pytest.mark.parametrize(("value", "kind"), PRIVATE)
def test_private_values(value, kind):
    text = f"before {value} behind"
    new, found = pii.pseudonymised(text, b"k")
    assert [s.kind for s in found] == [kind] and value not in new and pii.pseudonymised(text, b"k")[0] == new != pii.pseudonymised(text, b"other")[0]
    assert [s.kind for s in pii.spans(new, b"k")] == [kind] and pii.pseudonymised(new, b"k", back=True)[0] == text
    shape = lambda s: re.sub(r"\d", "9", s)
    assert kind in ("ip", "secret", "email") or shape(new) == shape(text)


def test_linked_and_left_alone():
    same = lambda a, b: [re.sub(r"\D", "", s.new) for t in (a, b) for s in pii.spans(t, b"k")]
    assert len(set(same("4111 1111 1111 1111", "4111111111111111"))) == 1 and len(set(same("+1 (017) 555-7713", "(017) 555-7713"))) == 2
    assert pii.date(b"k", "2024-02-29").split("-") == pii.date(b"k", "29.02.2024").split(".")[::-1]
    for clean in ("4111 1111 1111 1112", "9807915762804490", "2024-13-01", "30.02.2024", "000-11-2222", "300.1.1.1", "1.2.3.4.5", "DE89370400440532013001", "a @ b", "0000000000000000", "chapter 12, page 345", "", "1" * 5000):
        assert pii.pseudonymised(clean, b"k") == (clean, [])


def _valid_card(rng, n):
    d = "".join(rng.choice("0123456789") for _ in range(n - 1))
    return d + pii.luhn_digit(d)


def test_private_values_before_more_groups():
    rng = random.Random(5)
    groups = lambda d, *g: [d[sum(g[:i]) : sum(g[: i + 1])] for i in range(len(g))]
    cards = [(_valid_card(rng, sum(g)), g) for g in ((4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (16,)) for _ in range(60)]
    cases = [(x.join(groups(d, *g)), d, f"{before}{{}}{behind}") for d, g in cards for x in " -" for before, behind in (("", " 12/25"), ("", " 123"), ("", " 50 euros"), ("", "-12"), ("page 3 ", ""), ("7 ", " 9"))]
    ibans = ["BE68 5390 0754 7034", "BE68539007547034", "DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947", "GB29 NWBK 6016 1331 9268 19"]
    cases += [(v, v.replace(" ", ""), "to {}" + behind) for v in ibans for behind in (" AT bank", " EUR", " EURO today", " 2024", " IN 2024", "")]
    for value, bare, around in cases:
        text = around.format(value)
        new, found = pii.pseudonymised(text, b"k")
        assert [text[s.start : s.end] for s in found] == [value], text
        assert found[0].new.translate({32: None, 45: None}) == pii.spans(bare, b"k")[0].new and pii.pseudonymised(new, b"k", back=True)[0] == text


def test_private_runs_are_inverted():
    rng = random.Random(6)
    long = [_valid_card(rng, 19) for _ in range(300)]
    grouped = [" ".join(d[i : i + 4] for i in range(0, 19, 4)) for d in long]
    odd_groups = [" ".join(_valid_card(rng, n)) for n in (13, 14, 15, 16, 19) for _ in range(40)] + [f"{d[:6]} {d[6:16]} {d[16:]}" for d in long]
    for text in [*long, *grouped, *odd_groups]:
        new, found = pii.pseudonymised(text, b"k")
        assert len(found) == 1 and pii.pseudonymised(new, b"k", back=True)[0] == text
    for d, g in zip(long, grouped, strict=True):
        s = pii.spans(g, b"k")[0]
        if s.end == len(g):
            assert s.new.replace(" ", "") == pii.spans(d, b"k")[0].new


def test_feistel_is_a_permutation():
    assert sorted(pii.permute(b"k", "t", 97, x) for x in range(97)) == list(range(97))
    assert all(pii.permute(b"k", "t", 10**9, pii.permute(b"k", "t", 10**9, x), True) == x for x in range(50))


def test_private_odd(odd, empty):
    rows = pii.pseudonymise(odd, b"k").collect()
    assert len(rows) == len(ODD) and all(r.pseudonymised == r.text for r in rows) and pii.pseudonymise(empty, b"k").count() == 0


# 10 ----------------------------------------------------------------------------------------------------------------
def test_sketch_query_against_brute_force(spark, sf):
    rows = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = {r.doc_id: r for r in Q.op10_sketch(spark, sf).collect()}
    split = lambda s: {s} if s[:1] == "~" else {s[i : i + 16] for i in range(0, len(s), 16)}

    def near(a, b):
        apart = [any(x[0] == "~" for x in s) for s in (a, b)]
        if any(apart) or not a or not b:
            return float(a == b)
        return len(a & b) / min(len(a), len(b))

    for (i, t), (j, u) in zip(rows, rows[1:] + rows[:1], strict=True):
        edited = t[: len(t) - len(t) // 4] + u[: len(t) // 4]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = split(got[i].fingerprint), split(got[i].edited_fingerprint), split(got[j].fingerprint)
        assert got[i].near_edited == pytest.approx(near(a, b)) and got[i].near_next == pytest.approx(near(a, c))
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        assert bool(a) == bool(words) and len(a) <= max(1, len(words) - 2)
    assert np.mean([r.near_edited for r in got.values()]) > 0.6


def test_sketch_hashes_recomputed(spark, sf):
    """Every fingerprint from its text alone: chained xxHash64 of the words of each shingle, those in the lower half kept, else the least apart."""
    import xxhash

    def digits(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t.translate(UPPER)) if x]
        found = set()
        for i in range(max(1, len(w) - 2) if w else 0):
            h = 42
            for x in w[i : i + 3]:
                h = xxhash.xxh64_intdigest(x.encode(), seed=h)
            found.add(h)
        signed = lambda h: h - (h >> 63 << 64)
        kept = sorted((h for h in found if h >> 1 < 1 << 62), key=signed)
        return "".join(f"{h:016X}" for h in kept) or ("~%016X" % min(found, key=signed) if found else "")

    rows = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = {r.doc_id: r for r in Q.op10_sketch(spark, sf).collect()}
    assert len(got) == len(rows)
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1], strict=True):
        assert got[i].fingerprint == digits(t) and got[i].edited_fingerprint == digits(t[: len(t) - len(t) // 4] + u[: len(t) // 4])


def test_sketch_query_is_near_exact_likeness(spark):
    sf = "/root/testdata/sf0.01"
    rows = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got, errors = {r.doc_id: r for r in Q.op10_sketch(spark, sf).collect()}, defaultdict(list)

    def shingles_of(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t.translate(UPPER)) if x]
        return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()

    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1], strict=True):
        a, b, c = map(shingles_of, (t, t[: len(t) - len(t) // 4] + u[: len(t) // 4], u))
        if len(a) >= 8 and b and c:
            at = next(x for x in (250, 120, 60, 30, 8) if len(a) >= x)
            errors["edited", at].append(abs(got[i].near_edited - len(a & b) / min(len(a), len(b))))
            errors["next", at].append(abs(got[i].near_next - len(a & c) / min(len(a), len(c))))
    most = {8: 0.15, 30: 0.08, 60: 0.08, 120: 0.05, 250: 0.03}
    assert len(errors) == 10 and all(np.mean(e) < most[at] for (_, at), e in errors.items()), {k: np.mean(e) for k, e in errors.items()}


def test_sketch_keeps_below_a_fraction(spark):
    rng = random.Random(1)
    w = [f"w{rng.randrange(10**6)}" for _ in range(6000)]
    df = spark.createDataFrame([(0, " ".join(w)), (1, " ".join(w[:1500])), (2, " ".join(w[1500:])), (3, "A  b"), (4, "a b"), (5, None), (6, " ")], "i int, text string")
    s = {r.i: r.sketch for r in sketch.fingerprints(df).collect()}
    assert 0.8 < len(s[0].kept) / (5998 / 16) < 1.2 and set(s[1].kept) <= set(s[0].kept) and s[3] == s[4] and len(s[3].kept) + (s[3].least is not None) == 1
    assert s[5] == s[6] and s[5].kept == [] and s[5].least is None
    both = sketch.fingerprints(df).where("i IN (0, 1)").groupBy().pivot("i", [0, 1]).agg(F.first("sketch"))
    r = both.select(sketch.containment(F.col("1"), F.col("0")), sketch.likeness(F.col("1"), F.col("0")), sketch.merged(F.col("0"), F.col("1")).kept).first()
    assert r[0] == r[1] == 1.0 and r[2] == s[0].kept


def test_merged_sketch_is_that_of_all_shingles(spark):
    rng = random.Random(3)
    shingle = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(3))
    texts = [None, "", shingle(), shingle(), shingle(), " ".join(shingle() for _ in range(5)), " ".join(shingle() for _ in range(60))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    s = sketch.fingerprints(df)
    pairs = s.alias("a").join(s.alias("b"), F.col("a.i") <= F.col("b.i"))
    out = pairs.select(F.col("a.text").alias("x"), F.col("b.text").alias("y"), F.col("a.sketch").alias("s"), F.col("b.sketch").alias("t")).withColumn("m", sketch.merged(F.col("s"), F.col("t"))).withColumn("c", sketch.containment(F.col("s"), F.col("m"))).withColumn("l", sketch.likeness(F.col("s"), F.col("t"))).collect()
    assert len(out) == 28
    for r in out:
        every = sorted({*r.s.kept, *r.t.kept})
        rest = [x for x in (r.s.least, r.t.least) if x is not None]
        assert r.m.kept == every and r.m.least == (min(rest) if rest and not every else None)
        assert r.x != r.y or r.l == 1.0
        assert r.s.kept == [] or r.c == 1.0


def test_next_rows(spark, empty, odd):
    for ids in ([5, 1, 9, 9, 3], list(range(50)), [10**15, 1, 2, 3], [7], [None, 1, 2], [None, None], [4] * 9 + [-3, 5], [-(1 << 62), 1 << 62, 0, 1]):
        df = spark.createDataFrame([(i, f"t{n}") for n, i in enumerate(ids)], "doc_id long, text string")
        want = sorted(((i is not None, i or 0), f"t{n}") for n, i in enumerate(ids))
        got = {r.text: r.next_text for r in sketch.with_next(df, ["doc_id", "text"], ["text"], rows_each=2).collect()}
        assert got == {a[1]: b[1] for a, b in zip(want, want[1:] + want[:1], strict=True)}
    assert sketch.with_next(empty, ["doc_id"], ["text"]).count() == 0 and sketch.fingerprints(odd).count() == len(ODD)
