"""Document quality by a linear-chain conditional random field over the lines of a document.

Each line has shape features of its own and those of the lines before and behind it. The two-state chain
(good, bad) is fitted by maximum likelihood. Only documents are labelled, so the labels of lines are found in rounds: at first each line
has its document's; after a logistic fit on lines by themselves, without neighbours, those that look like the other kind take its label,
the surest first, up to ``MINORITY`` of a document's length. The chain is fitted to the lines' labels, so switches are learnt where lines
differ. Forward-backward gives the marginal of each line; the mean of the marginals, weighted by line length, goes
through a one-variable logistic link, fitted on the same documents, to the score.

Bounds of the sample that training sees (scoring has none): ``max_train`` labelled documents, those with the least hash of
their id, and of these in that order as many as have ``max_lines`` lines together; documents that alone have more are left out.

Defined results: a null text is empty; a document without any character that isn't white space scores the share of
good labels; null or conflicting labels (mean exactly 1/2) are left out of training; several labels of one document
count as their majority; of rows that repeat a labelled id the one whose text has the least digest is taken; without usable
labels of both kinds every score is the share of good labels, or 0.5.
Texts are read whole, whatever their length; neither id, language nor source is a feature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import beside, checkpointed, map_texts, ship, slices, text_or_empty

OWN = 12
#: own features, those of the line before and behind, whether there is one, and 1
WIDTH = 3 * OWN + 3

_CLASS = np.zeros(256, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 1
_CLASS[48:58] = 2
_CLASS[65:91] = 3
_CLASS[97:123] = 4
_CLASS[[33, 34, 39, 44, 45, 46, 58, 59, 63]] = 5
_CLASS[[i for i in range(33, 127) if not _CLASS[i]]] = 6
_CLASS[128:192] = 7
_CLASS[192:256] = 8


def lines_of(text: str) -> list[str]:
    return [x for x in text.split("\n") if x and not x.isspace()]


def own_features(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(lines, OWN) features and the length of each line in bytes."""
    raw = [x.encode() for x in lines]
    size = np.array([len(x) for x in raw], np.int64)
    start = np.concatenate(([0], np.cumsum(size)[:-1]))
    kind = _CLASS[np.frombuffer(b"".join(raw), np.uint8)]
    count = np.stack([np.add.reduceat(kind == k, start, dtype=np.int64) for k in range(1, 9)], 1).astype(np.float64)
    words = [x.split() for x in lines]
    n = np.array([len(w) for w in words], np.float64)
    distinct = np.array([len(set(w)) for w in words], np.float64)
    same = np.array([a == b for a, b in zip(lines, lines[1:], strict=False)] + [False], np.float64)
    chars = count[:, 1:7].sum(1) + count[:, 7]
    letters = count[:, 2] + count[:, 3] + count[:, 7]
    f = np.empty((len(lines), OWN))
    f[:, 0] = np.log1p(size) / 5
    f[:, 1] = count[:, 2] / np.maximum(letters, 1)
    f[:, 2] = 4 * count[:, 5] / np.maximum(chars, 1)
    f[:, 3] = 4 * count[:, 4] / np.maximum(chars, 1)
    f[:, 4] = 4 * count[:, 1] / np.maximum(chars, 1)
    f[:, 5] = chars / np.maximum(n, 1) / 8
    f[:, 6] = distinct / np.maximum(n, 1)
    f[:, 7] = (n > 8) * (1 - distinct / np.maximum(n, 1))
    f[:, 8] = np.minimum(1, count[:, 5] / np.maximum(n, 1))
    f[:, 9] = count[:, 3] / np.maximum(letters, 1)
    f[:, 10] = same
    f[:, 11] = n < 4
    return f, size


def with_neighbours(own: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(lines, WIDTH): ``first`` marks the first line of each document."""
    x = np.zeros((len(own), WIDTH))
    x[:, :OWN] = own
    inner = ~first[1:]
    x[1:, OWN : 2 * OWN][inner] = own[:-1][inner]
    x[:-1, 2 * OWN : 3 * OWN][inner] = own[1:][inner]
    x[1:, -3] = inner
    x[:-1, -2] = inner
    x[:, -1] = 1
    return x


@dataclass(frozen=True)
class Model:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(WIDTH))
    #: log potentials [before, now]; state 1 is good
    switch: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    link: tuple[float, float] = (0.0, 0.0)
    prior: float = 0.5


def marginals(unary: list[float], switch: np.ndarray) -> list[float]:
    """P(good) of each line of one document; ``unary``: its log odds without the chain. Messages are odds, so nothing over- or underflows."""
    (t00, t01), (t10, t11) = np.exp(switch).tolist()
    odds = np.exp(np.clip(unary, -30, 30)).tolist()
    ahead, r = [], 0.0
    for k, e in enumerate(odds):
        r = e * ((r * t11 + t01) / (r * t10 + t00)) if k else e
        ahead.append(r)
    out, b = [0.0] * len(odds), 1.0
    for k in range(len(odds) - 1, -1, -1):
        p = ahead[k] * b
        out[k] = p / (1 + p)
        q = odds[k] * b
        b = (q * t11 + t10) / (q * t01 + t00)
    return out


def linked(mean: float | None, model: Model) -> float:
    if mean is None or model.link == (0.0, 0.0):
        return model.prior
    return float(1 / (1 + np.exp(-(model.link[0] + model.link[1] * mean))))


def line_marginals(texts: list[str], model: Model) -> list[tuple[list[float], np.ndarray]]:
    """P(good) of each line of each text and the lines' lengths in bytes; lines of all texts are featurised together."""
    lines, count = [], []
    for t in texts:
        own = lines_of(t)
        lines += own
        count.append(len(own))
    if not lines:
        return [([], np.zeros(0, np.int64))] * len(texts)
    own, size = own_features(lines)
    ends = np.cumsum(count)
    first = np.zeros(len(lines), bool)
    first[(ends - count)[np.array(count) > 0]] = True
    own[:-1, 10] *= ~first[1:]
    unary = with_neighbours(own, first) @ model.weights
    return [(marginals(unary[e - n : e].tolist(), model.switch), size[e - n : e]) for e, n in zip(ends.tolist(), count, strict=True)]


def score_of(p: list[float], size: np.ndarray, model: Model) -> float:
    return linked(float(np.dot(p, size) / size.sum()) if p else None, model)


def score_batch(texts: list[str], model: Model) -> list[float]:
    return [score_of(p, size, model) for p, size in line_marginals(texts, model)]


#: Rounds in which lines are labelled anew, the odds from which a line counts as of the other kind, and the share of a document's length that may.
RELABELLED, SURE, MINORITY = 2, np.log(4.0), 0.45


def relabelled(y: int, odds: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Labels of one document's lines, given its label and each line's log odds of being good."""
    against = odds if y == 0 else -odds
    order = np.argsort(-against, kind="stable")
    fits = (against[order] > SURE) & (np.cumsum(size[order]) <= MINORITY * size.sum())
    out = np.full(len(size), y)
    out[order[np.logical_and.accumulate(fits)]] = 1 - y
    return out


def fit(docs: list[np.ndarray], sizes: list[np.ndarray], labels: np.ndarray, rounds: int = 250, ridge: float = 0.02) -> Model:
    """Maximum likelihood by Adam; ``docs`` holds the features of the lines of each document. Documents of alike length run side by side."""
    prior = float(labels.mean()) if len(labels) else 0.5
    keep = [i for i, d in enumerate(docs) if len(d)]
    if not keep or len(set(labels[keep].tolist())) < 2:
        return Model(prior=prior)
    keep.sort(key=lambda i: -len(docs[i]))
    y = labels[keep].astype(int)
    long = np.array([len(docs[i]) for i in keep])
    first = np.concatenate([[True] + [False] * (n - 1) for n in long])
    x = with_neighbours(np.concatenate([docs[i] for i in keep]), first)
    start = np.concatenate(([0], np.cumsum(long)[:-1]))
    # a document counts as much as sqrt of its number of lines, and both labels alike
    weight = 1 / np.sqrt(long)
    weight *= np.where(y == 1, 1 / max(1, y.sum()), 1 / max(1, (1 - y).sum()))
    wl = np.repeat(weight / weight.sum(), long)
    yl = np.repeat(y, long)
    alone = np.concatenate((x[:, :OWN], x[:, -1:]), 1)
    for _ in range(RELABELLED):
        odds = alone @ _alone(alone, yl, wl, rounds, ridge)
        yl = np.concatenate([relabelled(int(v), odds[a : a + n], sizes[i]) for v, a, n, i in zip(y, start, long, keep, strict=True)])
    w, s = _chain(x, yl, wl, first, start, long, rounds, ridge)
    mean = np.array([np.dot(marginals((x[a : a + n] @ w).tolist(), s), z := sizes[i]) / z.sum() for a, n, i in zip(start, long, keep, strict=True)])
    return Model(w, s, _link(mean, y), prior)


def _alone(x: np.ndarray, yl: np.ndarray, wl: np.ndarray, rounds: int, ridge: float) -> np.ndarray:
    """The weights of a logistic regression of the lines' labels, by damped Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds // 10):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (wl * (p - yl)) + ridge * 1e-2 * w
        h = (x * (wl * p * (1 - p))[:, None]).T @ x + ridge * 1e-2 * np.eye(len(w))
        w = w - np.clip(np.linalg.solve(h, g), -4, 4)
    return w


def _chain(x: np.ndarray, yl: np.ndarray, wl: np.ndarray, first: np.ndarray, start: np.ndarray, long: np.ndarray, rounds: int, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """(weights, switch) for lines x labelled yl and weighed wl; documents in descending order of their number of lines ``long``."""
    w, s = np.zeros(WIDTH), np.zeros((2, 2))
    active = [int((long > k).sum()) for k in range(long[0])]
    inner = np.flatnonzero(~first)
    moments = [np.zeros(WIDTH), np.zeros(WIDTH), np.zeros((2, 2)), np.zeros((2, 2))]
    for step in range(1, rounds + 1):
        u = np.clip(x @ w, -30, 30)
        e, t = np.exp(u), np.exp(s)
        ahead, back = np.empty_like(e), np.ones_like(e)
        for k, n in enumerate(active):
            at = start[:n] + k
            if k:
                r = ahead[at - 1]
                ahead[at] = e[at] * (r * t[1, 1] + t[0, 1]) / (r * t[1, 0] + t[0, 0])
            else:
                ahead[at] = e[at]
        for k in range(len(active) - 2, -1, -1):
            at = start[: active[k + 1]] + k
            q = e[at + 1] * back[at + 1]
            back[at] = (q * t[1, 1] + t[1, 0]) / (q * t[0, 1] + t[0, 0])
        odds = ahead * back
        p = odds / (1 + odds)
        gw = x.T @ (wl * (p - yl)) + ridge * 1e-2 * w
        q, r = e[inner] * back[inner], ahead[inner - 1]
        joint = np.stack([np.full_like(q, t[0, 0]), q * t[0, 1], r * t[1, 0], r * q * t[1, 1]], 1)
        joint /= joint.sum(1, keepdims=True)
        seen = np.zeros_like(joint)
        seen[np.arange(len(inner)), 2 * yl[inner - 1] + yl[inner]] = 1
        gs = (wl[inner, None] * (joint - seen)).sum(0).reshape(2, 2) + ridge * s
        for g, v, m, z in ((gw, w, 0, 1), (gs, s, 2, 3)):
            moments[m] = 0.9 * moments[m] + 0.1 * g
            moments[z] = 0.99 * moments[z] + 0.01 * g * g
            v -= 0.08 * (moments[m] / (1 - 0.9**step)) / (np.sqrt(moments[z] / (1 - 0.99**step)) + 1e-9)
    return w, s


def _link(mean: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one variable by Newton steps, lightly shrunk."""
    z, ab = np.stack([np.ones_like(mean), mean], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-(z @ ab)))
        g = z.T @ (p - y) + 0.1 * ab
        h = (z * (p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(2)
        ab = ab - np.clip(np.linalg.solve(h, g), -4, 4)
    return float(ab[0]), float(ab[1])


def train(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_train: int = 4000, max_lines: int = 400_000) -> Model:
    """Fits on at most ``max_train`` documents of ``max_lines`` lines together; only their line features (56 bytes a line) reach the driver."""
    ship()
    each = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("__id")).agg(F.avg(F.col(label).cast("double")).alias("__y"))
    some = each.where("__y <> 0.5").select("__id", (F.col("__y") > 0.5).cast("int").alias("__y")).orderBy(F.xxhash64("__id"), "__id").limit(max_train)
    found = df.join(F.broadcast(some), F.col(doc_id) == F.col("__id")).select("__id", "__y", text_or_empty(text).alias("__text"), F.sha2(text_or_empty(text), 256).alias("__sha"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                rows = []
                for t in part.column(2).to_pylist():
                    lines = lines_of(t)
                    if 0 < len(lines) <= max_lines:
                        own, size = own_features(lines)
                        rows.append((own.astype(np.float32).tobytes(), size.tobytes()))
                    else:
                        rows.append((b"", b""))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["id", "y", "sha", "own", "size"])

    featured = found.mapInArrow(run, "id long, y int, sha string, own binary, size binary")
    one = checkpointed(featured.groupBy("id").agg(F.min(F.struct("sha", "y", "own", "size")).alias("r")).select("id", "r.*", F.xxhash64("id").alias("h")))
    # sums over at most max_train pairs of an id and a number decide which rows are collected
    upto = one.select("id", F.sum(F.length("size") / 8).over(Window.orderBy("h", "id")).alias("upto"))
    rows = sorted(one.join(F.broadcast(upto.where(F.col("upto") <= max_lines).select("id")), "id").select("id", "y", "own", "size").collect(), key=lambda r: r.id)
    docs = [np.frombuffer(r.own, np.float32).reshape(-1, OWN).astype(np.float64) for r in rows]
    return fit(docs, [np.frombuffer(r.size, np.int64) for r in rows], np.array([r.y for r in rows], int))


def score(df: DataFrame, model: Model, text: str = "text", lines: str | None = None) -> DataFrame:
    """All columns of ``df`` and ``score``, which comes last and takes the place of one of that name.

    ``lines``: the name of one more column, array<struct<good: float, n_bytes: int>>: the marginal and the length of each line that isn't blank,
    in order; a line is labelled good if its marginal is 1/2 or more.
    """
    made = ["score", *([lines] if lines else [])]
    keep, kept = beside(df, *made)
    kind = pa.struct([("good", pa.float32()), ("n_bytes", pa.int32())])

    def work():
        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            found = line_marginals(part.column(part.num_columns - 1).to_pylist(), model)
            cols = [pa.array([score_of(p, size, model) for p, size in found], pa.float64())]
            if lines:
                at = np.concatenate(([0], np.cumsum([len(p) for p, _ in found]))).astype(np.int32)
                flat = [pa.array(np.concatenate([np.asarray(f[i], t) for f in found]), k) for i, t, k in ((0, np.float32, pa.float32()), (1, np.int32, pa.int32()))]
                cols.append(pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays(flat, fields=list(kind))))
            return pa.RecordBatch.from_arrays([*part.columns[:-1], *cols], [*keep, *made])

        return step

    return map_texts(df, keep, text, work, kept + "score double" + (f", `{lines}` array<struct<good:float,n_bytes:int>>" if lines else ""))
