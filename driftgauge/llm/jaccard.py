"""N-gram Jaccard self-join over a token-group matrix.

Documents are sets of word shingles. Equal sets collapse to one representative, the least id. Then:

1. Representatives that share a minimum of one of four hash orders are compared with the least id among them. Pairs at
   the similarity asked for are links; pairs at half of it or more join into groups of similar representatives, and
   linked ones into provisional components. A representative without such a pair is a group of its own.
2. The token-group matrix holds, for each group, the union of its members' rarest tokens. Only tokens that occur in
   several groups are in it. Tokens are ordered by a count sketch over all documents, then by hash; of a set of n tokens
   that must share a = ceil(t n) with a partner, the first n - a + l(n) go into the matrix (l(n) = 1 + n/50). Two linked
   sets share at least min(l) of those, so a query document is held against another group only if at least l of its
   tokens are in the group's union, and sizes allow it. The sketch is a first guess, whatever the data's size: the tokens that were
   chosen are then counted exactly, and those with more than 1,000 documents move to the end of the order (a bitmap of their hashes says
   which; any order that depends on the token alone is exact) and are chosen anew, in up to three rounds. What is
   still frequent then, in texts of nothing but frequent tokens, is joined in salted parts of 1,000 documents.
3. Qualifying groups are opened, and so is each group that isn't one component, against itself: queries and members
   meet in blocks of bounded size, whose overlaps are one matrix product, and only links that join components come out.

Every comparison is exact on whole sets; no bucket, partner or candidate is capped. Groups that are one component cost
links in proportion to their size. In a group that isn't, because its members are about as far apart as the similarity
asked for, all pairs of blocks are multiplied, spread over tasks; rows stay in proportion to the group's size times its blocks.

No key meets in one task: minima, digests of equal sets, tokens and centres of stars that hold many rows are joined
by ``matched`` or in parts, and are aggregated before shuffling.

Defined results: a null or empty text has an empty set and is linked with nothing; equal sets are one component even
if their texts differ; a null id is never a representative, and takes the component of its set, if any; ids must cast to long (a text that isn't a
number is an error); texts of any length are compared whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import HOT_KEYS, checkpointed, matched, ship, slices, text_or_empty
from .components import components
from .shingles import mix, sets

ORDERS = 4
#: Counters of the frequency sketch, and of them in one row.
WIDTH, BLOCK = 1 << 20, 1 << 15
#: Bits of the filters that spare shuffling what can't match: 16 a value, within these powers of two (2 to 32 MB). Beyond 33 million values they pass more, up to all.
FILTER_BITS = (24, 28)
#: Documents of one token in the matrix, beyond which it counts as frequent, and rounds of choosing.
MOST_HITS, ROUNDS = 1_000, 3
JUMPS = 2
#: Sets in one block, on either side.
ROWS = 256
_SALTS = mix(np.arange(1, ORDERS + 1, dtype=np.uint64))
LINKED = "a long, b long, shared long, size_a long, size_b long"


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def described(df: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Of each row (id, n, hi, lo, minima): size, digest and minima of its set; and the rows of the frequency sketch."""
    ship()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(WIDTH, np.uint32)
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                got = sets(part.column(1), k)
                if any(len(s) for s in got):
                    held = np.concatenate(got)
                    counts += np.bincount((held >> np.uint64(44)).astype(np.int64), minlength=WIDTH).astype(np.uint32)
                digest = [(int(mix(s).sum(dtype=np.uint64)), int(mix(s + _SALTS[0]).sum(dtype=np.uint64))) if len(s) else (0, 0) for s in got]
                minima = [_signed(np.array([mix(s ^ x).min() for x in _SALTS])) if len(s) else np.zeros(0, np.int64) for s in got]
                pairs = _signed(np.array(digest, np.uint64).reshape(-1, 2))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in got], pa.int64()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(minima, pa.list_(pa.int64())), pa.nulls(len(got), pa.binary())],
                    ["id", "n", "hi", "lo", "minima", "counts"],
                )
        if counts.any():
            blocks = np.minimum(counts, 65535).astype(np.uint16).reshape(-1, BLOCK)
            some = pa.array([zlib.compress(b.tobytes(), 1) for b in blocks], pa.binary())
            n = len(blocks)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(range(n), pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64())), some], ["id", "n", "hi", "lo", "minima", "counts"])

    rows = checkpointed(df.mapInArrow(run, "id long, n long, hi long, lo long, minima array<long>, counts binary"))
    return rows.where("counts is null").drop("counts"), rows.where("counts is not null").select(F.col("hi").alias("block"), "counts")


def levels(sketch: DataFrame) -> np.ndarray:
    """One byte per counter: 0 up to twice the usual count, then its binary logarithm above it. Fixed size, whatever the data's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[block] = total.get(block, 0) + np.frombuffer(zlib.decompress(counts), np.uint16).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(total, pa.int64()), pa.array([t.tobytes() for t in total.values()], pa.binary())], ["block", "counts"])

    out = np.zeros(WIDTH, np.int64)
    for r in sketch.repartition(WIDTH // BLOCK, "block").mapInArrow(run, "block long, counts binary").collect():
        out[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.counts, np.int64)
    usual = max(4.0, float(np.median(out)))
    return np.maximum(0, np.floor(np.log2(np.maximum(out, 1) / usual))).astype(np.uint8)


def passes(ids: DataFrame, hashed: Column) -> np.ndarray:
    """A bitmap that holds the 64-bit hash of every row; its length is a power of two, in 32-bit words."""
    power = min(max(FILTER_BITS[0], (16 * ids.count()).bit_length()), FILTER_BITS[1])
    bit = F.pmod(hashed, F.lit(1 << power))
    words = ids.groupBy(F.shiftright(bit, 5).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(32)).cast("int"))).alias("bits")).toArrow()
    out = np.zeros(1 << (power - 5), np.uint32)
    out[words.column("w").to_numpy()] = words.column("bits").to_numpy().astype(np.uint32)
    return out


def hits(bitmap: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Which of the 64-bit hashes the bitmap holds."""
    bit = hashed & (32 * len(bitmap) - 1)
    return (bitmap[bit >> 5] >> (bit & 31).astype(np.uint32) & 1).astype(bool)


def token_sets(df: DataFrame, k: int, wanted: DataFrame) -> DataFrame:
    """(id, tokens) of the rows whose id is in ``wanted`` (id; checkpointed), and of a few more."""
    bitmap = df.sparkSession.sparkContext.broadcast(passes(wanted, F.xxhash64("id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = bitmap.value
        for batch in batches:
            few = batch.filter(pa.array(hits(keep, batch.column(2).to_numpy())))
            for part in slices(few, 1, 1 << 20):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in sets(part.column(1), k)], pa.binary())], ["id", "tokens"])

    return df.select("id", "text", F.xxhash64("id").alias("hashed")).where("id is not null").mapInArrow(run, "id long, tokens binary")


def verified(df: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """The (a, b) pairs with their exact set sizes and overlap."""
    pairs = checkpointed(pairs)
    # a head may have any number of partners: they are dealt into parts, and its set goes once to each
    partners = checkpointed(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("c"), F.ceil(F.count(F.lit(1)) / MOST_HITS).cast("int").alias("parts")))
    ends = checkpointed(partners.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    held = token_sets(df, k, ends)
    part = matched(pairs, partners, ["a"], pairs.count()).select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    heads = partners.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).join(held.select(F.col("id").alias("a"), F.col("tokens").alias("tokens_a")), "a")
    one = part.join(held.select(F.col("id").alias("b"), F.col("tokens").alias("tokens_b")), "b")
    two = one.join(heads, ["a", "part"]).select("a", "b", "tokens_a", "tokens_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y, swap = y, x, True
                else:
                    swap = False
                at = np.minimum(np.searchsorted(y, x), max(0, len(y) - 1))
                shared = int((y[at] == x).sum()) if len(y) else 0
                out.append((shared, len(y), len(x)) if swap else (shared, len(x), len(y)))
            cols = np.array(out, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(cols[:, i]) for i in range(3))], ["a", "b", "shared", "size_a", "size_b"])

    return two.mapInArrow(run, LINKED)


def linking(num: int, den: int) -> Column:
    return F.col("shared") * den >= (F.col("size_a") + F.col("size_b") - F.col("shared")) * num


def need(n: Column, num: int, den: int) -> Column:
    """The least overlap that a set of n tokens has with a partner."""
    return F.ceil(n * num / den)


def extra(n):
    return 1 + n // 50 if isinstance(n, int) else (1 + F.floor(n / 50))


def rare_tokens(df: DataFrame, k: int, num: int, den: int, level: np.ndarray, frequent: list[np.ndarray]) -> DataFrame:
    """(id, kept, tokens): the tokens of each set that go into the matrix, rarest first; those in the bitmaps ``frequent`` (over the tokens' own bits) come last."""
    held = df.sparkSession.sparkContext.broadcast((level, frequent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, frequent = held.value
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                rows = []
                for s in sets(part.column(1), k):
                    n = len(s)
                    rank = level[(s >> np.uint64(44)).astype(np.int64)].astype(np.int16)
                    for bitmap in frequent:
                        rank += hits(bitmap, _signed(s)) * np.int16(100)
                    order = np.argsort(rank, kind="stable")
                    rows.append(_signed(s[order[: n + (-n * num) // den + extra(n)]]) if n else np.zeros(0, np.int64))
                sizes = pa.array([len(s) for s in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), sizes, pa.array(rows, pa.list_(pa.int64()))], ["id", "kept", "tokens"])

    return df.select("id", "text").where("id is not null").mapInArrow(run, "id long, kept long, tokens array<long>")


def only(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rows`` with those of their tokens that ``wanted`` (token) has, and a few more."""
    bitmap = rows.sparkSession.sparkContext.broadcast(passes(wanted, F.col("token")))
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = bitmap.value
        for batch in batches:
            tokens = batch.column("tokens")
            ok = hits(keep, tokens.flatten().to_numpy())
            size = pc.list_value_length(tokens).to_numpy()
            left = np.add.reduceat(np.concatenate((ok, [False])).astype(np.int64), np.concatenate(([0], np.cumsum(size)))[:-1]) * (size > 0) if len(size) else size
            new = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(left))), pa.int32()), tokens.flatten().filter(pa.array(ok)))
            yield pa.RecordBatch.from_arrays([new if c == "tokens" else batch.column(c) for c in names], names).filter(pa.array(left > 0))

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema))


def block_links(df: DataFrame, queries: DataFrame, members: DataFrame, k: int, num: int, den: int, own: bool) -> DataFrame:
    """(a, b) links between queries (grp, id, comp) and members (grp, id, comp) of the same group, in blocks; a spanning set of those that join components.

    ``own``: the queries are the members of the groups; they meet each other once.
    """
    queries, members = checkpointed(queries), checkpointed(members)
    held = token_sets(df, k, checkpointed(queries.select("id").union(members.select("id")).distinct()))
    # groups of more than one block on either side are few; the others need no look-up
    size = members.select("grp", F.lit(1).alias("m"), F.lit(0).alias("q")).union(queries.select("grp", F.lit(0), F.lit(1))).groupBy("grp").agg(*[F.greatest(F.ceil(F.sum(c) / ROWS), F.lit(1)).cast("int").alias(f"{c}_blocks") for c in ("m", "q")], F.count(F.lit(1)).alias("c"))
    size = checkpointed(size)
    large = size.where("m_blocks > 1 OR q_blocks > 1")
    few, total = large.limit(HOT_KEYS + 1).count() <= HOT_KEYS, members.count() + queries.count()
    sized = lambda d: (d.join(F.broadcast(large), "grp", "left").fillna(1, ["m_blocks", "q_blocks"]) if few else matched(d, size, ["grp"], total)).drop("c")
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    x = sized(members).withColumn("mb", block("m_blocks")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)))
    q = sized(queries).withColumn("qb", block("q_blocks")).withColumn("mb", F.explode(F.sequence(F.lit(0), F.col("m_blocks") - 1)))
    each = x.select("grp", "qb", "mb", "id", "comp", F.lit(1).alias("side")).union(q.select("grp", "qb", "mb", "id", "comp", F.lit(0).alias("side")))
    if own:  # groups against themselves: the lower half of the block pairs is the upper half again
        each = each.where("qb <= mb")
    rows = each.join(held, "id").select("grp", "qb", "mb", "side", "id", "comp", "tokens")

    def run(t: pa.Table) -> pa.Table:
        side = t.column("side").to_numpy()
        ids, comps = t.column("id").to_numpy(), t.column("comp").to_numpy()
        raw = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("tokens")]
        n = np.array([len(x) for x in raw])
        at = [np.flatnonzero(side == s) for s in (0, 1)]
        none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        if not len(at[0]) or not len(at[1]):
            return none
        flat = [np.concatenate([raw[i] for i in w]) for w in at]
        who = [np.repeat(np.arange(len(w)), n[w]) for w in at]
        common = np.intersect1d(*flat)
        shared = np.zeros((len(at[0]), len(at[1])), np.float32)
        for c in range(0, len(common), 4096):
            cols = common[c : c + 4096]
            sides = []
            for f, w, rows_of in zip(flat, who, at, strict=True):
                place = np.minimum(np.searchsorted(cols, f), len(cols) - 1)
                hit = cols[place] == f
                m = np.zeros((len(rows_of), len(cols)), np.float32)
                m[w[hit], place[hit]] = 1
                sides.append(m)
            shared += sides[0] @ sides[1].T
        shared = shared.astype(np.int64)
        union = n[at[0]][:, None] + n[at[1]][None, :] - shared
        linked = (shared * den >= union * num) & (comps[at[0]][:, None] != comps[at[1]][None, :])
        root: dict[int, int] = {}

        def find(v: int) -> int:
            while (p := root.get(v, v)) != v:
                root[v] = v = root.get(p, p)
            return v

        out = []
        for i, j in zip(*np.nonzero(linked), strict=True):
            a, b = find(int(comps[at[0][i]])), find(int(comps[at[1][j]]))
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((ids[at[0][i]], ids[at[1][j]]))
        return pa.table({"a": pa.array([o[0] for o in out], pa.int64()), "b": pa.array([o[1] for o in out], pa.int64())}) if out else none

    return rows.groupBy("grp", "qb", "mb").applyInArrow(run, "a long, b long")


def jaccard_components(df: DataFrame, k: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, representative) of each row; sets link at Jaccard similarity num/den or more."""
    if not 0 < num <= den:
        raise ValueError("the similarity must be over 0 and at most 1")
    ship()
    docs = df.select(F.col(doc_id).cast("long").alias("id"), text_or_empty(text).alias("text"))
    rows, sketch = described(docs, k)
    digests = checkpointed(rows.where("n > 0").groupBy("hi", "lo", "n").agg(F.min("id").alias("rep"), F.first("minima").alias("minima"), F.count(F.lit(1)).alias("c")))
    reps = digests.where("rep is not null")
    n_reps = reps.count()

    # 1. components and groups
    keys = reps.select("rep", "n", F.posexplode("minima").alias("slot", "key"))
    heads = keys.groupBy("slot", "key").agg(F.min(F.struct("rep", "n")).alias("head"), F.count(F.lit(1)).alias("c")).where("c > 1")
    fits = (F.col("n") * num <= F.col("head.n") * 2 * den) & (F.col("head.n") * num <= F.col("n") * 2 * den)
    pairs = matched(keys, checkpointed(heads), ["slot", "key"], ORDERS * n_reps).where((F.col("rep") != F.col("head.rep")) & fits).select(F.col("head.rep").alias("a"), F.col("rep").alias("b")).distinct()
    alike = checkpointed(verified(docs, pairs, k).where(linking(num, 2 * den)))
    links = alike.where(linking(num, den)).select("a", "b")
    least = checkpointed(alike.groupBy(F.col("b").alias("rep")).agg(F.min(F.when(linking(num, den), F.col("a"))).alias("link"), F.min("a").alias("kin")).select("rep", F.coalesce("link", "rep").alias("comp"), F.col("kin").alias("grp")))
    # a representative's least partner has a least partner itself, and so on: a few steps bring nearly all of a group to one leader.
    # Equal labels always mean that there is a path; where labels stay apart, later steps find the links all the same.
    n_least = least.count()
    for at in ("comp", "grp") * JUMPS if n_least else ():
        up = least.groupBy(at).agg(F.count(F.lit(1)).alias("c")).join(least.select(F.col("rep").alias(at), F.col(at).alias("up")), at, "left")
        least = checkpointed(matched(least, checkpointed(up), [at], n_least).withColumn(at, F.coalesce("up", at)).select("rep", "comp", "grp"))
    groups = checkpointed(reps.select("rep", "n").join(least, "rep", "left").select("rep", "n", F.coalesce("comp", "rep").alias("comp"), F.coalesce("grp", "rep").alias("grp")))
    whole = checkpointed(groups.groupBy("grp").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("c")))

    # 2. the matrix
    each = lambda x: x.select("rep", "n", "grp", F.explode("tokens").alias("token"))
    level, frequent = levels(sketch), []
    for last in [False] * (ROUNDS - 1) + [True]:
        rare = checkpointed(rare_tokens(docs, k, num, den, level, frequent).join(groups, F.col("id") == F.col("rep")).select("rep", "n", "grp", "tokens"))
        several = checkpointed(each(rare).groupBy("token").agg(F.min("grp").alias("low"), F.max("grp").alias("high"), F.count(F.lit(1)).alias("c")).where("low < high").select("token", "c"))
        often = several.where(F.col("c") > MOST_HITS)
        if last or often.isEmpty():
            break
        frequent.append(passes(often, F.col("token")))
    hot = F.ceil(F.col("c") / MOST_HITS).cast("int")
    probes = checkpointed(matched(each(only(rare, several)), several, ["token"], several.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]).withColumn("parts", hot).drop("c"))
    matrix = probes.groupBy("token", "grp", "parts").agg(F.min("n").alias("least"), F.max("n").alias("most")).withColumnRenamed("grp", "g")
    matrix = matrix.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    found = (
        probes.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
        .join(matrix, ["token", "part"])
        .where((F.col("grp") > F.col("g")) & (F.col("n") * num <= F.col("most") * den) & (F.col("least") * num <= F.col("n") * den))
        .groupBy("rep", "n", "g")
        .agg(F.count(F.lit(1)).alias("hits"))
        .where(F.col("hits") >= extra(need(F.col("n"), num, den)))
    )

    # 3. opened groups
    members_of = lambda grps: matched(groups, checkpointed(grps), ["grp"], n_reps).select("grp", F.col("rep").alias("id"), "comp")
    across = checkpointed(found.select(F.col("g").alias("to"), "rep").join(groups.select("rep", "comp"), "rep").select(F.col("to").alias("grp"), F.col("rep").alias("id"), "comp"))
    inside = checkpointed(members_of(whole.where("low < high").select("grp", "c")))
    for asked, own in ((inside, True), (across, False)):
        if not asked.isEmpty():
            members = asked if own else members_of(whole.join(asked.select("grp").distinct(), "grp").select("grp", "c"))
            links = links.union(block_links(docs, asked, members, k, num, den, own))
    return _labelled(rows, digests, components(links))


def _labelled(rows: DataFrame, sets_: DataFrame, nodes: DataFrame) -> DataFrame:
    named = checkpointed(sets_.select("hi", "lo", "n", "c", "rep").join(nodes, F.col("rep") == F.col("node"), "left").select("hi", "lo", "n", "c", "rep", F.coalesce("component", "rep").alias("comp")))
    some = rows.where("n > 0")
    found = matched(some, named, ["hi", "lo", "n"], some.count()).select("id", "n", "comp", "rep")
    return found.union(rows.where("n = 0").select("id", "n", "id", "id")).toDF("doc_id", "n_shingles", "component_id", "representative")


def duckdb_sql(k: int, num: int, den: int) -> str:
    """``jaccard_components`` of ``documents`` in DuckDB SQL: all pairs of different sets that share a shingle. Quadratic in common shingles, so for small tables."""
    shingle = " || ' ' || ".join(f"w[i + {j}]" if j else "w[i]" for j in range(k))
    return f"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, list_sort(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < {k} THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - {k - 2}), lambda i: {shingle})) END) AS s FROM w),
    r AS (SELECT doc_id, s, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY s) END AS rep FROM s),
    e AS (SELECT rep, len(s) AS n, unnest(s) AS x FROM r WHERE doc_id = rep),
    p AS (SELECT a.rep AS a, b.rep AS b FROM e a JOIN e b ON a.x = b.x AND a.rep < b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING count(*) * {den} >= (a.n + b.n - count(*)) * {num}),
    l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
    c(node, least) AS (SELECT rep, rep FROM r WHERE doc_id = rep UNION SELECT l.b, c.least FROM c JOIN l ON l.a = c.node AND c.least < l.b)
    SELECT r.doc_id, len(s)::BIGINT AS n_shingles, m.component_id, r.rep AS representative FROM r JOIN (SELECT node, min(least) AS component_id FROM c GROUP BY 1) m ON m.node = r.rep
    """
