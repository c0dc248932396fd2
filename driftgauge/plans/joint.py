"""Rasch fits of incomplete panels by Newton steps on the abilities, over any number of items and workers.

The penalised likelihood is that of ``fit.adam``: the mean log loss of the seen cells, a ridge on abilities and one on centred drift, none on
difficulty; drift is 0 at the source and has mean 0 in each language, source abilities have mean 0. Given the abilities, and a
multiplier per language for the mean of drift, items are independent. So each step is one pass over the items: a task solves its items, a few at a time, and
adds up what they contribute to the gradient and, their own parameters eliminated, to the Hessian of the abilities. These sums are as
large as (models x languages) squared whatever the number of items; they are added up by rows, and the driver solves for the step. No worker holds the panel, and no state of an
item is kept between steps: a lost task is done again from the checkpointed items.

Models and languages are small dimensions: with more than ``MOST`` pairs of them a fit is refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .fit import Fit

MOST = 3000
#: Difficulties stay within this bound: an item that all or no models solve has no finite one.
FAR = 10.0
#: Ridges of the published fits.
RIDGE_THETA, RIDGE_DELTA = 1e-4, 1e-3
_CHUNK = 1 << 22  # numbers of a task's block of items


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def solve_items(y: np.ndarray, w: np.ndarray, theta: np.ndarray, push: np.ndarray, ridge: float, source: int, rounds: int = 80, tol: float = 1e-11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(u, p, K) of items (n, models, languages) given the abilities: u[:, source] is the difficulty, the other columns drift; K is the Hessian.

    Each item minimises its log loss + ridge |drift|^2 + push . drift, with a difficulty within ``FAR``.
    """
    n, _, k = y.shape
    found, free = (np.zeros((n, k)), np.zeros_like(y, float), np.zeros((n, k, k))), np.arange(k) != source
    diagonal, left, u, held = np.arange(k), np.arange(n), np.zeros((n, k)), (w * y).sum(1)
    for turn in range(rounds + 1):
        beta = u + u[:, [source]] * free
        p = w * _sigmoid(theta[None] - beta[:, None, :])
        v = (p - p * p).sum(1)  # w is 0 or 1
        miss = held - p.sum(1)
        g = miss + free * (2 * ridge * u + push)
        g[:, source] = miss.sum(1)
        h = np.zeros((len(u), k, k))
        h[:, diagonal, diagonal] = v + free * 2 * ridge
        h[:, source, :] = h[:, :, source] = v
        h[:, source, source] = v.sum(1) + 1e-9
        stuck = np.flatnonzero((np.abs(u[:, source]) >= FAR) & (g[:, source] * u[:, source] < 0))  # would go on beyond the bound
        g[stuck, source] = h[stuck, :, source] = h[stuck, source, :] = 0
        h[stuck, source, source] = 1e12
        # items that are done leave the block: most take few rounds, some many
        done = (np.abs(g).max(1, initial=0) <= tol) | (turn == rounds)
        for whole, part in zip(found, (u, p, h), strict=True):
            whole[left[done]] = part[done]
        if done.all():
            break
        on = ~done
        left, u, w, held, g, h = left[on], u[on], w[on], held[on], g[on], h[on]
        u = u - np.clip(np.linalg.solve(h, g[:, :, None])[:, :, 0], -1, 1)
        u[:, source] = np.clip(u[:, source], -FAR, FAR)
    return found


def contributions(y: np.ndarray, w: np.ndarray, theta: np.ndarray, push: np.ndarray, ridge: float, source: int) -> np.ndarray:
    """What items add to the Newton system of (abilities, multipliers): a square of ``1 + models languages + languages``, whose first row and column hold gradient and log loss."""
    n, m, k = y.shape
    u, p, h = solve_items(y, w, theta, push, ridge, source)
    v = p - p * p
    inverse = np.linalg.inv(h)
    free = (np.arange(k) != source).astype(float)
    # in terms of each language's total beta: columns of q are (difficulty + drift of the language)
    q = np.eye(k)
    q[source, :] = 1
    g = q.T @ inverse @ q
    out = np.zeros((1 + m * k + k, 1 + m * k + k))
    cells, tops = slice(1, 1 + m * k), slice(1 + m * k, None)
    beta = u + u[:, [source]] * free
    eta = theta[None] - beta[:, None, :]
    out[0, 0] = (w * (np.logaddexp(0, eta) - y * eta)).sum()
    out[0, cells] = (p - w * y).sum(0).ravel()
    out[0, tops] = (u * free).sum(0)
    schur = np.zeros((m, k, m, k))
    for a in range(k):
        for b in range(k):
            schur[:, a, :, b] = -(v[:, :, a] * g[:, None, a, b]).T @ v[:, :, b]
    schur = schur.reshape(m * k, m * k)
    schur[np.diag_indices(m * k)] += v.sum(0).ravel()
    out[cells, cells] = schur
    # the response of drift to abilities, and to its own multipliers
    moved = np.einsum("iml,ijl->mlj", v, inverse @ q) * free
    out[cells, tops] = moved.reshape(m * k, k)
    out[tops, tops] = -inverse.sum(0) * free[:, None] * free[None]
    return out


def newton(total: np.ndarray, theta: np.ndarray, top: np.ndarray, ridge: float, source: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(abilities, multipliers, size of the step) from the sums over all items: gradient and constraints to zero, one linear solve."""
    m, k = theta.shape
    size, rest = m * k, [i for i in range(k) if i != source]
    keep = [1 + size + i for i in rest]
    big = np.zeros((size + k, size + k))
    big[:size, :size] = total[1 : 1 + size, 1 : 1 + size] + 2 * ridge * np.eye(size)
    big[:size, size:-1] = total[1 : 1 + size, keep]
    big[size:-1, :size] = total[1 : 1 + size, keep].T
    big[size:-1, size:-1] = total[np.ix_(keep, keep)]
    centre = np.zeros((m, k))
    centre[:, source] = 1
    big[-1, :size] = big[:size, -1] = centre.ravel()  # source abilities have mean 0
    right = np.zeros(size + k)
    right[:size] = -(total[0, 1 : 1 + size] + 2 * ridge * theta.ravel())
    right[size:-1] = -total[0, keep]
    right[-1] = -theta[:, source].sum()
    step = np.linalg.lstsq(big, right, rcond=1e-13)[0]
    length = np.abs(step[:size]).max()
    step *= min(1.0, 1.0 / max(length, 1e-300))
    new_top = top.copy()
    new_top[rest] += step[size:-1]
    return theta + step[:size].reshape(m, k), new_top, float(length)


def _numbered(values: DataFrame, column: str, most: int) -> list:
    found = [r[0] for r in values.select(column).distinct().orderBy(column).limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} values of {column}: it must be a small dimension")
    return found


@dataclass(frozen=True)
class Packed:
    """One row per panel and item: the places of its cells (model by language) and their marks; with the axes, and how many cells and items each panel has."""

    items: DataFrame
    models: list
    languages: list
    at: int
    counts: dict
    n_items: dict
    rep_type: str
    kind: dict


def _packed(responses: DataFrame, source, by: str | None) -> Packed:
    spark, kind = responses.sparkSession, {f.name: f.dataType.simpleString() for f in responses.schema}
    rep, rep_type = (F.col(by), kind[by]) if by else (F.lit(0), "int")
    models, languages = _numbered(responses, "model", MOST), _numbered(responses, "language", MOST)
    m, k = len(models), len(languages)
    if source not in languages:
        raise ValueError(f"the source language {source!r} isn't there")
    if None in models or None in languages or m * k > MOST:
        raise ValueError(f"models and languages must be known and at most {MOST} pairs")
    number = lambda values, name: F.broadcast(spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"`{name}` {kind[name]}, __{name} int"))
    cells = responses.join(number(models, "model"), "model").join(number(languages, "language"), "language")
    cell = F.struct((F.col("__model") * k + F.col("__language")).alias("at"), F.col("correct").cast("int").alias("y"))
    packed = cells.groupBy(rep.alias("rep"), "item").agg(F.collect_list(cell).alias("cells"))  # no longer than models by languages
    once = F.size("cells") == F.size(F.array_distinct("cells.at"))
    sound = F.when(once & F.col("item").isNotNull(), F.col("cells.at")).otherwise(F.raise_error(F.lit("a cell comes twice, or an item is null")).cast("array<int>"))
    items = cut(packed.select("rep", "item", sound.alias("at"), F.col("cells.y").alias("y")))
    sizes = items.groupBy("rep").agg(F.sum(F.size("at")).alias("n"), F.count(F.lit(1)).alias("items")).collect()  # panels are few
    return Packed(items, models, languages, languages.index(source), {r.rep: r.n for r in sizes}, {r.rep: r["items"] for r in sizes}, rep_type, kind)


def _blocks(frames: Iterator[pd.DataFrame], m: int, k: int) -> Iterator[tuple]:
    """(rep, items, y, w) of packed rows, at most so many items at once."""
    most = max(1, _CHUNK // (m * k))
    for frame in frames:
        for r, group in frame.groupby("rep", sort=True):
            for lo in range(0, len(group), most):
                part = group.iloc[lo : lo + most]
                place = np.repeat(np.arange(len(part)), part["at"].map(len).to_numpy()) * (m * k) + np.concatenate(part["at"].to_list())
                y, w = np.zeros(len(part) * m * k), np.zeros(len(part) * m * k)
                y[place], w[place] = np.concatenate(part["y"].to_list()), 1
                yield r, part["item"], y.reshape(-1, m, k), w.reshape(-1, m, k)


def fit_joint(responses: DataFrame, source, by: str | None = None, ridge_theta: float = RIDGE_THETA, ridge_delta: float = RIDGE_DELTA, tol: float = 1e-8, rounds: int = 60) -> Fit:
    """The fit of ``responses`` (model, item, language, correct), of which cells may be absent; with ``by`` one of each value of that column, all in the same passes.

    The tables have ``rep``: the value of ``by``, else 0; ``info`` is (rep, loss, n): log loss of the seen cells and their number. Every value of ``by`` has parameters for all models, items that occur there, and languages; what no cell says
    anything of is held by the ridges alone. A cell that comes twice in one panel is an error, and so is a model, item or language that is null.
    """
    spark = responses.sparkSession
    p = _packed(responses, source, by)
    items, models, languages, at, counts, n_items, rep_type, kind = p.items, p.models, p.languages, p.at, p.counts, p.n_items, p.rep_type, p.kind
    m, k = len(models), len(languages)
    ridges = {r: (ridge_theta * n / (m * k), ridge_delta * n / (n_items[r] * k)) for r, n in counts.items()}
    theta, top, done = {r: np.zeros((m, k)) for r in counts}, {r: np.zeros(k) for r in counts}, set()

    def summed(of: dict, tops: dict) -> dict:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total: dict = {}
            for r, _, y, w in _blocks(frames, m, k):
                part = contributions(y, w, of[r], tops[r], ridges[r][1], at)
                total[r] = total[r] + part if r in total else part
            for r, t in total.items():
                yield pd.DataFrame({"rep": r, "row": np.arange(len(t)), "sums": list(t)})

        def add(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            yield pd.DataFrame({"rep": [key[0]], "row": [key[1]], "sums": [sum(np.sum(np.stack(f["sums"]), 0) for f in frames)]})

        schema = f"rep {rep_type}, row int, sums array<double>"
        left = items.where(F.col("rep").isin(list(of)))
        rows = left.mapInPandas(run, schema).groupBy("rep", "row").applyInPandas(add, schema).collect()  # (models x languages) squared
        out = {r: np.zeros((1 + m * k + k,) * 2) for r in of}
        for x in rows:
            out[x.rep][x.row] = x.sums
        return out

    losses = {}
    for _ in range(rounds):
        left = [r for r in counts if r not in done]
        if not left:
            break
        for r, total in summed({r: theta[r] for r in left}, {r: top[r] for r in left}).items():
            losses[r] = total[0, 0] / counts[r]
            theta[r], top[r], length = newton(total, theta[r], top[r], ridges[r][0], at)
            if length < tol:
                done.add(r)
    if len(done) < len(counts):
        raise ValueError("the fit didn't converge")

    def last(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for r, item, y, w in _blocks(frames, m, k):
            u, _, _ = solve_items(y, w, theta[r], top[r], ridges[r][1], at)
            drift = u * (np.arange(k) != at)
            yield pd.DataFrame({"rep": r, "item": item.to_numpy(), "b": u[:, at], "delta": list(drift)})

    solved = cut(items.mapInPandas(last, f"rep {rep_type}, item {kind['item']}, b double, delta array<double>"))
    names = spark.createDataFrame([(i, v) for i, v in enumerate(languages)], f"pos int, language {kind['language']}")
    drift = solved.select("rep", "item", F.posexplode("delta").alias("pos", "delta")).join(F.broadcast(names), "pos").select("rep", "item", "language", "delta")
    typed = f"rep {rep_type}, model {kind['model']}, language {kind['language']}, theta double, weight long, gap double"
    rows = [(r, a, b, float(t[i, j]), 1, float(t[i, at] - t[i, j])) for r, t in theta.items() for i, a in enumerate(models) for j, b in enumerate(languages)]
    people = spark.createDataFrame(rows, typed)
    info = spark.createDataFrame([(r, float(losses[r]), counts[r]) for r in counts], f"rep {rep_type}, loss double, n long")
    return Fit(people.select("rep", "model", "language", "theta"), solved.select("rep", "item", "b"), drift, people.select("rep", "model", "language", "weight", "gap"), info)
