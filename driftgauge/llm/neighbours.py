"""Approximate nearest neighbours by inner product: a hierarchical navigable small-world graph per shard, the shards' results merged.

Rows are dealt to shards by a hash of their id, so neither a cluster nor a vector that a third of all rows share makes a shard large. A shard's
graph is one row of flat arrays (``INDEX``): its distinct vectors, for each the least ids that have it, and per level a table of
neighbours, a fixed number to a node. Nodes are numbered from the highest level down, so a level is the first so many of them. Inner products are turned into
distances by one more component, which gives all vectors of a shard the same norm and is 0 for a query.

Search streams the queries of a block past each shard's graph: a task holds one graph and one batch of queries. Work is queries times
shards times the logarithm of a shard; a shard holds at most about ``SHARD_BYTES`` and ``SHARD_ROWS``: with the beam's width that bounds what a
walk can miss, as of the best of all rows each shard has to find only its few.

Defined results: rows whose id or vector is null, or whose vector is empty, all zero, or holds a null or non-finite component, take no part,
as candidate or query. Equal rows (same id, same vector) count once. Ids should be unique and cast to long; of rows that share an id
each is a candidate with its own vector and a query of its own, under the same ``query_id``, and none is a candidate of the other. Vectors only meet those of their own length.
Ties go to the smaller id. An empty table, of rows or queries, gives an empty result. Columns other than the two named are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import checkpointed, ship

SHARD_BYTES, SHARD_ROWS, LEAST_SHARDS = 32 << 20, 1 << 14, 16
#: Queries that one task sends through a shard's graph.
BLOCK = 1 << 16
#: Links of a node above the ground level, where it has twice as many; width of the beams when building and searching.
LINKS, BUILD_BEAM, SEARCH_BEAM = 16, 96, 128
#: Visited marks of a batch of queries take at most so many bytes.
_MARKS = 32 << 20

#: sizes: nodes by level; links: the levels' neighbour tables one behind another, -1 where a node has fewer; ids of node i: from starts[i] to starts[i + 1].
INDEX = "dim int, shard int, ids array<bigint>, starts array<int>, vectors array<double>, sizes array<int>, links array<int>"
FOUND = "query_id bigint, query_hash bigint, vec_id bigint, score double"


def usable(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, vector, dim) of the rows that take part, equal ones once: summed up before the shuffle, so a row that comes often isn't a hot key."""
    v = F.col(embedding).cast("array<double>")
    fine = (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists(v, lambda x: x != 0)
    return rows.where(F.col(vec_id).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("vector"), F.size(v).alias("dim")).distinct()


# one shard -----------------------------------------------------------------------------------------------------------
def _lifted(x: np.ndarray) -> np.ndarray:
    """Single-precision rows of equal norm, whose inner products with (q, 0) are those of ``x`` with q."""
    square = (x * x).sum(1)
    top = square.max()
    scale = 1 / np.sqrt(top)  # keeps single precision from overflow
    return np.concatenate([x * scale, np.sqrt(np.maximum(1 - square / top, 0))[:, None]], 1).astype(np.float32)


def beams(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, width: int, n: int, at_once: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, likeness), best first, -1 where fewer: the ``width`` best that each query meets from its ``entry`` nodes on, over the first ``n`` nodes.

    All queries move in step; each opens its best ``at_once`` unopened nodes, and ends when its beam holds none.
    """
    b = len(q)
    seen = np.zeros(b * n, bool)
    row = np.repeat(np.arange(b), entry.shape[1])
    node = entry.ravel()
    ids, like, unopened = np.full((b, width), -1), np.full((b, width), -np.inf, np.float32), np.zeros((b, width), bool)
    while True:
        fresh = np.unique((row * n + node)[node >= 0])
        fresh = fresh[~seen[fresh]]
        if len(fresh):
            seen[fresh] = True
            row, node = np.divmod(fresh, n)
            value = np.einsum("ij,ij->i", x[node], q[row])
            first = np.searchsorted(row, np.arange(b))
            place = np.arange(len(row)) - first[row]
            more = int(place.max()) + 1
            new_ids, new_like = np.full((b, more), -1), np.full((b, more), -np.inf, np.float32)
            new_ids[row, place], new_like[row, place] = node, value
            both, both_ids = np.concatenate([like, new_like], 1), np.concatenate([ids, new_ids], 1)
            flags = np.concatenate([unopened, new_ids >= 0], 1)
            order = np.argsort(-both, 1, kind="stable")[:, :width]
            like, ids, unopened = (np.take_along_axis(a, order, 1) for a in (both, both_ids, flags))
        chosen = unopened & (np.cumsum(unopened, 1) <= at_once)
        row, col = np.nonzero(chosen)
        if not len(row):
            return ids, like
        unopened[row, col] = False
        around = links[ids[row, col]]
        row, node = np.repeat(row, around.shape[1]), around.ravel()


def spread(x: np.ndarray, near: np.ndarray, like: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates ``near`` (best first, -1: none) at most ``most``: first those nearer to the row than to any chosen before, then the best of the rest."""
    b, c = near.shape
    pts = x[np.maximum(near, 0)]
    between = pts @ pts.transpose(0, 2, 1)
    there, taken, rank, left = near >= 0, np.zeros((b, c), bool), np.full((b, c), 2 * c), np.full(b, most)
    closest = np.full((b, c), -np.inf, np.float32)  # of each candidate to any chosen one
    for j in range(c):
        ok = there[:, j] & (left > 0) & (like[:, j] > closest[:, j])
        taken[ok, j] = True
        left -= ok
        closest = np.where(ok[:, None], np.maximum(closest, between[:, j]), closest)
    place = np.arange(c)[None]
    rank = np.where(taken, place, np.where(there, c + place, 2 * c))
    order = np.argsort(rank, 1, kind="stable")[:, :most]
    chosen = np.take_along_axis(near, order, 1)
    return np.pad(chosen, ((0, 0), (0, most - chosen.shape[1])), constant_values=-1)


def _best(near: np.ndarray, like: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(np.where(near >= 0, -like, np.inf), 1, kind="stable")[:, :most]
    return np.take_along_axis(near, order, 1), np.take_along_axis(like, order, 1)


def _link_back(x: np.ndarray, links: np.ndarray, source: np.ndarray, target: np.ndarray) -> None:
    """``source`` becomes a neighbour of ``target``, pair by pair; of a node with too many the spread ones stay."""
    new = ~(links[target] == source[:, None]).any(1)  # two nodes of a batch may have chosen each other
    source, target = source[new], target[new]
    order = np.lexsort((source, target))
    source, target = source[order], target[order]
    nodes, first, times = np.unique(target, return_index=True, return_counts=True)
    wide = links.shape[1]
    for lo in range(0, len(nodes), 256):
        t, f, c = nodes[lo : lo + 256], first[lo : lo + 256], times[lo : lo + 256]
        near = np.full((len(t), wide + int(c.max())), -1)
        near[:, :wide] = links[t]
        row = np.repeat(np.arange(len(t)), c)
        near[row, wide + np.arange(len(row)) - np.repeat(np.cumsum(c) - c, c)] = source[f[0] : f[0] + len(row)]
        like = np.einsum("ijk,ik->ij", x[np.maximum(near, 0)], x[t])
        near, like = _best(near, like, 2 * wide)
        full = (near >= 0).sum(1) > wide
        links[t[~full]] = np.pad(near[~full, :wide], ((0, 0), (0, max(0, wide - near.shape[1]))), constant_values=-1)
        if full.any():
            links[t[full]] = spread(x, near[full], like[full], wide)


def build_graph(x: np.ndarray, links: int = LINKS, beam: int = BUILD_BEAM) -> tuple[list[int], list[np.ndarray]]:
    """(nodes by level, neighbour table by level) of rows ``x`` of equal norm: one in ``links`` of a level's nodes is on the next one too.

    Rows should come in random order: the first ones are the upper levels. Nodes come in by batches that are no larger than what is there; those of a batch are
    candidates for each other as well.
    """
    sizes = [len(x)]
    while sizes[-1] > links:
        sizes.append(-(-sizes[-1] // links))
    tables: list[np.ndarray] = []  # from the top level down
    for level in range(len(sizes) - 1, -1, -1):
        n, wide = sizes[level], links * (1 if level else 2)
        table = np.full((n, wide), -1, np.int32)
        above = sizes[level + 1] if level + 1 < len(sizes) else 0
        a = 0
        while a < n:
            b = min(n, a + max(1, min(a, 256, _MARKS // n)), above if a < above else n)
            q = x[a:b]
            near, like = np.full((b - a, 0), -1), np.zeros((b - a, 0), np.float32)
            if a:
                entry = np.zeros((b - a, 1), np.int64) if a < above else descend(x, sizes, tables, q, level)
                near, like = beams(x, table, q, entry, min(beam, a), a)
            own = q @ q.T
            np.fill_diagonal(own, -np.inf)
            others = np.broadcast_to(np.arange(a, b), own.shape).copy()
            np.fill_diagonal(others, -1)
            near, like = _best(np.concatenate([near, others], 1), np.concatenate([like, own], 1), beam)
            chosen = spread(x, near, like, links)
            table[a:b, : chosen.shape[1]] = chosen
            row, col = np.nonzero(chosen >= 0)
            _link_back(x, table, a + row, chosen[row, col])
            a = b
        tables.append(table)
    return sizes, tables[::-1]


def descend(x: np.ndarray, sizes: list[int], tables: list[np.ndarray], q: np.ndarray, level: int) -> np.ndarray:
    """The node of the level above ``level`` where each query's walk from the top ends; ``tables`` are from the top down."""
    at = np.zeros((len(q), 1), np.int64)
    for up in range(len(sizes) - 1, level, -1):
        found, _ = beams(x, tables[len(sizes) - 1 - up], q, at, min(4, sizes[up]), sizes[up], 1)
        at = found[:, :1]
    return at


class Graph:
    """A row of the index, ready for queries."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, vectors: np.ndarray, sizes: list[int], links: np.ndarray):
        self.ids, self.starts, self.vectors, self.sizes, self.x = ids, starts, vectors, sizes, _lifted(vectors)
        parts = sizes if links.size else []
        wide = links.size // (2 * parts[0] + sum(parts[1:])) if parts else 0
        ends = np.cumsum([n * wide * (1 if level else 2) for level, n in enumerate(parts)])
        self.tables = [t.reshape(n, -1) for t, n in zip(np.split(links, ends[:-1]), sizes, strict=True)][::-1]

    def search(self, q: np.ndarray, query_ids: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the query, id, score) of the ``k`` best found for each, in double precision."""
        n = self.sizes[0]
        norm = np.abs(q).max(1, keepdims=True)  # a query's length doesn't matter to order
        lifted = np.concatenate([q / norm, np.zeros((len(q), 1))], 1).astype(np.float32)
        step, out = max(1, min(256, _MARKS // n)), []
        for lo in range(0, len(q), step):
            part = lifted[lo : lo + step]
            entry = descend(self.x, self.sizes, self.tables, part, 0)
            near, _ = beams(self.x, self.tables[-1], part, entry, min(beam, n), n)
            row, col = np.nonzero(near >= 0)
            node = near[row, col]
            score = np.concatenate([(self.vectors[node[i : i + 8192]] * q[lo + row[i : i + 8192]]).sum(1) for i in range(0, len(node), 8192)])
            many = self.starts[node + 1] - self.starts[node]
            which = np.repeat(np.arange(len(node)), many)
            vec = self.ids[np.repeat(self.starts[node] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
            row, score = lo + row[which], score[which]
            other = vec != query_ids[row]
            row, score, vec = row[other], score[other], vec[other]
            order = np.lexsort((vec, -score, row))
            row, score, vec = row[order], score[order], vec[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            out.append((row[place < k], vec[place < k], score[place < k]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))


# all shards ----------------------------------------------------------------------------------------------------------
def build(rows: DataFrame, shards: int, keep: int, links: int = LINKS, beam: int = BUILD_BEAM) -> DataFrame:
    """The index (``INDEX``) of usable rows (vec_id, vector, dim). Of the ids that share a vector a shard keeps the least ``keep``: others can't be among the best ``keep`` of any query."""

    def shard(key: tuple, group: pa.Table) -> pa.Table:
        dim, number = (v.as_py() for v in key)
        ids = group.column("vec_id").to_numpy()
        flat = group.column("vector").combine_chunks()
        x = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dim)
        distinct, node = np.unique(x, axis=0, return_inverse=True)
        mixed = np.random.Generator(np.random.PCG64(number)).permutation(len(distinct))  # of sorted rows: the same whatever order they came in
        new = np.empty_like(mixed)
        new[mixed] = np.arange(len(mixed))
        node, vectors = new[node.ravel()], distinct[mixed]
        order = np.lexsort((ids, node))
        node, ids = node[order], ids[order]
        least = np.arange(len(node)) - np.searchsorted(node, node) < keep
        node, ids = node[least], ids[least]
        starts = np.searchsorted(node, np.arange(len(vectors) + 1)).astype(np.int32)
        sizes, tables = build_graph(_lifted(vectors), links, beam)
        one = lambda a, t: pa.array([a], pa.list_(t))
        flat_links = np.concatenate([t.ravel() for t in tables])
        made = [pa.array([dim], pa.int32()), pa.array([number], pa.int32()), one(ids, pa.int64()), one(starts, pa.int32()), one(vectors.ravel(), pa.float64()), one(np.array(sizes, np.int32), pa.int32()), one(flat_links, pa.int32())]
        return pa.Table.from_arrays(made, names=["dim", "shard", "ids", "starts", "vectors", "sizes", "links"])

    ship()
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    return dealt.groupBy("dim", "shard").applyInArrow(shard, INDEX)


def search_index(index: DataFrame, queries: DataFrame, k: int, shards: int, blocks: int = 1, beam: int = SEARCH_BEAM) -> DataFrame:
    """(query_id, query_hash, vec_id, score): the best ``k`` of each shard for usable ``queries`` (vec_id, vector, dim)."""
    ship()
    pairs = F.sequence(F.lit(0), F.lit(shards - 1))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    none = lambda t: F.lit(None).cast(t)
    asked = queries.select("dim", F.explode(pairs).alias("shard"), block.alias("block"), F.lit(1).alias("kind"), F.col("vec_id").alias("query_id"), F.xxhash64("vector").alias("query_hash"), "vector", none("array<bigint>").alias("ids"), none("array<int>").alias("starts"), none("array<int>").alias("sizes"), none("array<int>").alias("links"))
    graphs = index.select("dim", "shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(0).alias("kind"), none("bigint").alias("query_id"), none("bigint").alias("query_hash"), F.col("vectors").alias("vector"), "ids", "starts", "sizes", "links")
    both = graphs.unionByName(asked).repartition(shards * blocks, "dim", "shard", "block").sortWithinPartitions("dim", "shard", "block", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, place = None, None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(4)], 1)
            turns = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(1)) + 1).tolist(), len(keys)]
            for lo, hi in zip(turns[:-1], turns[1:], strict=True):
                part, at = batch.slice(lo, hi - lo), tuple(keys[lo, :3].tolist())
                flat = part.column("vector").flatten().to_numpy(zero_copy_only=False)
                if keys[lo, 3] == 0:
                    array = lambda c, part=part: part.column(c).flatten().to_numpy(zero_copy_only=False)
                    graph, place = Graph(array("ids"), array("starts").astype(np.int64), flat.reshape(-1, at[0]), array("sizes").tolist(), array("links")), at
                elif place == at:
                    ids, marks = part.column("query_id").to_numpy(), part.column("query_hash").to_numpy()
                    row, vec, score = graph.search(flat.reshape(-1, at[0]), ids, k, beam)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(marks[row]), pa.array(vec), pa.array(score)], names=["query_id", "query_hash", "vec_id", "score"])

    return both.mapInArrow(run, FOUND)


def search(rows: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", links: int = LINKS, build_beam: int = BUILD_BEAM, search_beam: int = SEARCH_BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each of ``queries`` among ``rows``, nearest first, all of them if there are fewer; never a row of the query's id."""
    if k < 1 or search_beam <= k:
        raise ValueError("k must be at least 1 and less than the search's beam")
    taken, asked = usable(rows, vec_id, embedding), usable(queries, vec_id, embedding)
    n, values = taken.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("dim").cast("long")), F.lit(0))).first()
    shards = max(LEAST_SHARDS, -(-8 * values // SHARD_BYTES), -(-n // SHARD_ROWS))
    blocks = max(1, -(-asked.count() // BLOCK))
    index = checkpointed(build(taken, shards, k + 1, links, build_beam))
    found = search_index(index, asked, k, shards, blocks, search_beam)
    ranked = found.selectExpr("*", "row_number() OVER (PARTITION BY query_id, query_hash ORDER BY score DESC, vec_id) AS rank")
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
