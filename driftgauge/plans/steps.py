"""The two-parameter fit's gradient steps over blocks of items: no worker holds a panel, whatever its size.

Items meet only in the abilities and in two means of drift by language, so a step is two passes over the blocks. One moves the items and adds up
their drift, the other, which knows that mean, adds up what their cells say of the abilities and of drift's gradient. Between passes only these sums, as many a block as
models times languages, come together, added in the order of blocks: results don't depend on how blocks are dealt to threads or tasks. The steps are ``fit.adam``'s.
"""

from __future__ import annotations

import os
import pickle
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import _folder, cut
from .joint import MOST, _numbered

#: Items to a block; a panel of up to ``_FEW`` blocks takes its steps in one worker (some 130,000 items), as a pass of Spark costs more than such a step; a larger one takes passes of Spark.
_ITEMS, _FEW = 16384, 8
#: Threads of a worker at most: with a fourth, threads wait for one another as much as it computes.
_THREADS = 3
#: Cells that are computed at once: few enough for a core's cache, and so many that threads seldom wait for one another.
_TILE = 65536
#: Steps between checkpoints: a lost block is worked out again from the last.
_KEEP = 100


@dataclass
class Block:
    """Some items of one panel. ``slot`` are places among items by languages with ``times`` fitted cells each, the fewest first; ``at`` is a cell's place among models by languages, ``y`` its mark, both in the order of ``_tiles``; ``held`` are (at, slot, y) of the cells held out.

    ``p`` is difficulty, drift and discrimination before they are normalised, ``one`` and ``two`` their moments, ``grads`` the gradients of a step that isn't taken yet.
    """

    panel: int
    number: int
    at: np.ndarray
    slot: np.ndarray
    times: np.ndarray
    y: np.ndarray
    held: tuple[np.ndarray, np.ndarray, np.ndarray]
    p: list[np.ndarray]
    one: list[np.ndarray]
    two: list[np.ndarray]
    grads: list[np.ndarray] | None = None

    def wide(self) -> list[tuple[slice, np.ndarray, np.ndarray, list[np.ndarray]]]:
        """(places in ``slot``, ``at``, ``y`` less a half, room for four results) by tile, one column a slot, as numpy computes with them; kept while the block stays in its worker."""
        if not hasattr(self, "_wide"):
            self._wide, done, room = [], 0, np.empty((4, max([c * (of.stop - of.start) for of, c in _tiles(self.times)], default=0)))
            for of, c in _tiles(self.times):
                cells, shape = slice(done, done := done + c * (of.stop - of.start)), (c, of.stop - of.start)
                self._wide.append((of, self.at[cells].astype(np.intp).reshape(shape), self.y[cells].reshape(shape) - 0.5, [x[: shape[0] * shape[1]].reshape(shape) for x in room]))
        return self._wide

    def __getstate__(self) -> dict:
        return {c: v for c, v in self.__dict__.items() if c != "_wide"}


@dataclass
class Told:
    """What all blocks of a panel are told: how many steps it has begun, abilities, the means of drift and of its gradient, which languages are free, how many cells are fitted and numbers of drift there are."""

    t: int
    th: np.ndarray
    mean: np.ndarray
    tilt: np.ndarray
    free: np.ndarray
    total: float
    size: int
    ridge: float
    rate: float


def _tiles(times: np.ndarray) -> Iterator[tuple[slice, int]]:
    """(places, cells each) of slots with equally many cells, ``_TILE`` cells at once."""
    for c, lo, n in zip(*(x.tolist() for x in np.unique(times, return_index=True, return_counts=True)), strict=True):
        wide = max(1, _TILE // c)
        for i in range(lo, lo + n, wide):
            yield slice(i, min(i + wide, lo + n)), c


def block(panel: int, number: int, items: pd.Series, at: np.ndarray, y: np.ndarray, keep: np.ndarray, k: int) -> Block:
    if items.isna().any():
        raise ValueError("an item is null")
    values, item = np.unique(items.to_numpy(), return_inverse=True)
    slot = item.astype(np.int64) * k + at % k
    order = np.lexsort((at, slot))
    at, slot, y, keep = at[order].astype(np.int16), slot[order].astype(np.int32), y[order].astype(bool), keep[order].astype(bool)
    if ((np.diff(slot) == 0) & (np.diff(at) == 0)).any():
        raise ValueError("a cell comes twice")
    own, first, times = np.unique(slot[keep], return_index=True, return_counts=True)
    few = np.argsort(times, kind="stable")
    own, first, times = own[few], first[few], times[few].astype(np.int16)
    cells = np.concatenate([np.zeros(0, np.intp), *[(first[of] + np.arange(c)[:, None]).ravel() for of, c in _tiles(times)]])
    p = [np.zeros(len(values)), np.zeros((len(values), k)), np.full((len(values), k), 0.5413)]
    return Block(panel, number, at[keep][cells], own, times, y[keep][cells], (at[~keep], slot[~keep], y[~keep]), p, [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p])


def moved(p: list[np.ndarray], one: list[np.ndarray], two: list[np.ndarray], grads: list[np.ndarray], t: int, rate: float) -> None:
    """One step of all parameters, in place."""
    for x, v, u, q in zip(p, grads, one, two, strict=True):
        u *= 0.9
        u += 0.1 * v
        q *= 0.999
        w = v * v
        w *= 0.001
        q += w
        np.multiply(q, 1 / (1 - 0.999**t), out=w)
        np.sqrt(w, out=w)
        w += 1e-8
        np.divide(u, w, out=w)
        w *= rate / (1 - 0.9**t)
        x -= w


def settled(b: Block, told: Told) -> np.ndarray:
    """Takes the step that ``b`` has begun; the sum of its drift by language."""
    if b.grads is not None:
        b.grads[1] -= told.tilt
        moved(b.p, b.one, b.two, b.grads, told.t, told.rate)
        b.grads = None
    return b.p[1].sum(0)


def _normal(b: Block, told: Told) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(difficulty and drift, discrimination, its slope, drift) by item and language."""
    d = (b.p[1] - told.mean) * told.free
    e = np.exp(-np.abs(b.p[2]))
    return (b.p[0][:, None] + d).ravel(), (np.maximum(b.p[2], 0) + np.log1p(e)).ravel(), np.where(b.p[2] < 0, e, 1) / (1 + e), d


def _logs(x: np.ndarray) -> float:
    """The sum of the logarithms of numbers from 1 to 2: of products, each of 64 numbers."""
    x = x.ravel()
    n = x.size // 64
    return float(np.log(np.multiply.reduce(x[: n * 64].reshape(64, n), 0)).sum() + np.log(np.multiply.reduce(x[n * 64 :])))


def begun(b: Block, told: Told) -> np.ndarray:
    """Settles ``b`` and begins a step: its log loss, squares of drift, drift's gradient by language and the abilities' gradient."""
    settled(b, told)
    k, th, loss = len(told.free), told.th.ravel(), 0.0
    beta, a, slope, d = _normal(b, told)
    beta_of, a_of, people = beta[b.slot], a[b.slot], np.zeros(told.th.size)
    sums, sums_a = np.zeros(len(b.slot)), np.zeros(len(b.slot))
    for of, at, half, (core, eta, e, x) in b.wide():
        np.take(th, at, out=core, mode="clip")
        core -= beta_of[of]
        np.multiply(core, a_of[of], out=eta)
        np.abs(eta, out=e)
        np.multiply(eta, half, out=x)
        loss += 0.5 * float(e.sum()) - float(x.sum())
        np.negative(e, out=e)
        np.exp(e, out=e)
        np.add(1, e, out=x)
        loss += _logs(x)
        e /= x
        np.subtract(0.5, e, out=e)
        np.copysign(e, eta, out=e)  # the chance of a right answer, less a half
        e -= half
        core *= e
        sums_a[of] = core.sum(0)
        e *= a_of[of]
        sums[of] = e.sum(0)
        people += np.bincount(at.ravel(), e.ravel(), th.size)
    by_slot, by_a = np.zeros(b.p[1].size), np.zeros(b.p[1].size)
    by_slot[b.slot], by_a[b.slot] = sums / told.total, sums_a / told.total
    by_slot = by_slot.reshape(-1, k)
    gd = (2 * told.ridge * d / told.size - by_slot) * told.free
    b.grads = [-by_slot.sum(1), gd, by_a.reshape(-1, k) * slope]
    return np.concatenate([[loss, (d**2).sum()], gd.sum(0), people / told.total])


def judged(b: Block, told: Told) -> np.ndarray:
    """Log loss of the cells held out and their number, after the last step."""
    settled(b, told)
    beta, a, _, _ = _normal(b, told)
    at, slot, y = b.held
    eta = a[slot] * (told.th.ravel()[at] - beta[slot])
    if not np.isfinite(eta).all():
        raise ValueError("the fit has logits that aren't finite")
    return np.array([(np.logaddexp(0, eta) - y * eta).sum(), len(eta)])


#: A pass: what a function makes of each block of the panels that are told something, by panel and number.
Pass = Callable[[Callable[[Block, Told], np.ndarray], dict[int, Told]], Iterable[tuple[tuple[int, int], np.ndarray]]]


def descend(look: Pass, change: Pass, totals: dict[int, int], items: dict[int, int], m: int, k: int, source: int, steps: int = 4000, rate: float = 0.05, ridge_theta: float = 1e-4, ridge_delta: float = 1e-3, tol: float = 1e-8) -> dict[int, tuple[float, int]]:
    """(held-out log loss, steps taken) of each panel's two-parameter fit. ``look`` may forget what it did to the blocks, ``change`` keeps it."""
    free = np.ones(k)
    free[source] = 0
    told = {r: Told(0, np.zeros((m, k)), np.zeros(k), np.zeros(k), free, max(1.0, float(n)), items[r] * k, ridge_delta, rate) for r, n in totals.items()}
    mine = {r: ([np.zeros((m, k))], [np.zeros((m, k))], [np.zeros((m, k))]) for r in totals}
    before, left = dict.fromkeys(totals, np.inf), set(totals)

    def summed(of: Pass, f: Callable[[Block, Told], np.ndarray], panels: Iterable[int]) -> dict[int, np.ndarray]:
        out: dict[int, np.ndarray] = {}
        for (r, _), x in sorted(of(f, {r: told[r] for r in panels}), key=lambda y: y[0]):
            out[r] = out[r] + x if r in out else x
        return out

    for t in range(1, steps + 1):
        if not left:
            break
        if t > 1:
            for r, x in summed(look, settled, left).items():
                told[r].mean = x / items[r]
        for r, x in summed(change, begun, left).items():
            now, th = told[r], told[r].th
            loss = x[0] / now.total + ridge_theta * (th**2).mean() + ridge_delta * x[1] / now.size
            g = x[2 + k :].reshape(m, k) + 2 * ridge_theta * th / th.size
            of = g.copy()
            of[:, source] -= g.sum() / m
            moved(*mine[r], [of], t, rate)
            now.t, now.tilt, now.th = t, x[2 : 2 + k] / items[r], mine[r][0][0] - mine[r][0][0][:, source].mean()
            if abs(before[r] - loss) < tol:
                left.discard(r)
            before[r] = loss
    for r, x in summed(look, settled, totals).items():
        told[r].mean = x / items[r]
    return {r: (float(x[0] / x[1]) if x[1] else float("nan"), told[r].t) for r, x in summed(look, judged, totals).items()}


def held_out(cells: DataFrame, source, steps: int = 4000) -> DataFrame:
    """(seed, loss, steps): held-out log loss of each seed's two-parameter fit of ``cells`` (seed, model, item, language, correct, keep); models and languages are small dimensions."""
    spark, kind = cells.sparkSession, {f.name: f.dataType.simpleString() for f in cells.schema}
    models, languages = _numbered(cells, "model", MOST), _numbered(cells, "language", MOST)
    m, k = len(models), len(languages)
    if None in models or None in languages or m * k > MOST:
        raise ValueError(f"models and languages must be known and at most {MOST} pairs")
    if source not in languages:
        raise ValueError(f"the source language {source!r} isn't there")
    of = languages.index(source)
    number = lambda values, name: F.broadcast(spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"`{name}` {kind[name]}, __{name} int"))
    blocks = max(1, -(-cells.select("item").distinct().count() // _ITEMS))
    placed = cells.join(number(models, "model"), "model").join(number(languages, "language"), "language").select(
        "seed", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int").alias("block"), "item", (F.col("__model") * k + F.col("__language")).alias("at"), F.col("correct").cast("int").alias("y"), F.col("keep")
    )

    def pack(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        b = block(int(key[0]), int(key[1]), f["item"], f["at"].to_numpy(), f["y"].to_numpy(), f["keep"].to_numpy(), k)
        return pd.DataFrame({"seed": [key[0]], "block": [key[1]], "items": [len(b.p[0])], "fitted": [len(b.at)], "packed": [pickle.dumps(b, 5)]})

    packed = cut(placed.groupBy("seed", "block").applyInPandas(pack, f"seed {kind['seed']}, block int, items long, fitted long, packed binary"))
    sizes = packed.groupBy("seed").agg(F.sum("items").alias("items"), F.sum("fitted").alias("fitted")).collect()  # one row per seed
    items, totals = {r.seed: r["items"] for r in sizes}, {r.seed: r.fitted for r in sizes}
    if blocks <= _FEW:

        seeds = sorted(totals)
        sc = spark.sparkContext
        # the stage has a task a seed: its threads take cores that would be idle
        threads = max(1, min(_THREADS, sc.defaultParallelism // len(seeds), int(sc.getConf().get("spark.executor.cores", str(_THREADS)))))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = [pickle.loads(x) for f in frames for x in f["packed"]]
            if not held:
                return
            r = held[0].panel
            with ThreadPoolExecutor(min(threads, len(held), len(os.sched_getaffinity(0)))) as pool:
                each = lambda f, told: list(pool.map(lambda b: ((b.panel, b.number), f(b, told[b.panel])), held))
                loss, taken = descend(each, each, {r: totals[r]}, {r: items[r]}, m, k, of, steps)[r]
            yield pd.DataFrame({"seed": [r], "loss": [loss], "steps": [taken]})

        # a task a seed, by its place and not by its hash, so that no task takes the steps of two
        task = (F.array_position(F.array(*[F.lit(r).cast("long") for r in seeds]), F.col("seed").cast("long")) - 1).cast("int")
        return packed.repartitionById(len(seeds), task).mapInPandas(run, f"seed {kind['seed']}, loss double, steps int")
    found = _spread(packed, blocks, lambda look, change: descend(look, change, totals, items, m, k, of, steps))
    return spark.createDataFrame([(r, *x) for r, x in found.items()], f"seed {kind['seed']}, loss double, steps int")


def _spread(packed: DataFrame, blocks: int, work: Callable[[Pass, Pass], dict]) -> dict:
    """``work`` over blocks that are dealt to all cores; what a change makes of them is kept in the executors, and in the shared folder every ``_KEEP`` changes."""
    sc = packed.sparkSession.sparkContext
    _folder(packed.sparkSession)
    parts = min(blocks, sc.defaultParallelism)
    # a record is (key, sums, block as bytes): who only wants the sums doesn't unpack the block; all panels of a block are in one task, so tasks stay even as panels end
    now = packed.select("seed", "block", "packed").rdd.map(lambda x: ((x.block, x.seed), bytes(x.packed))).partitionBy(parts, lambda key: key[0]).map(lambda x: ((x[0][1], x[0][0]), None, x[1])).persist()
    changes = 0

    def look(f, told):
        def one(x):
            return (x[0], f(pickle.loads(x[2]), told[x[0][0]]))

        return now.filter(lambda x: x[0][0] in told).map(one).collect()  # sums

    def change(f, told):
        nonlocal now, changes

        def one(x):
            if x[0][0] not in told:
                return (x[0], None, x[2])
            b = pickle.loads(x[2])
            return (x[0], f(b, told[x[0][0]]), pickle.dumps(b, 5))

        last, now, changes = now, now.map(one).persist(), changes + 1
        if changes % _KEEP == 0:
            now.checkpoint()
        out = now.filter(lambda x: x[0][0] in told).map(lambda x: (x[0], x[1])).collect()  # sums
        last.unpersist()
        return out

    try:
        return work(look, change)
    finally:
        now.unpersist()
