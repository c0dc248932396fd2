"""Periodic runs of words: text that repeats itself on the spot, as broken pages and looping models write it.

A run is a maximal stretch of words with smallest period q and at least ``power`` periods. A word of a run equals the one q places
on, or back, so at least ``overlap`` consecutive words of each run come again in the same text, and every word of a run lies in a
k-gram that does (k: that least overlap). Words outside such k-grams can't be part of a run and cut the text into segments; each
segment that is long enough goes through the divide-and-conquer search of Main and Lorentz.

Defined results of ``periodic_runs``: a null or empty text, or one without words, has no runs and an empty ``collapsed``; texts of any length
are taken whole; each row counts by itself, repeated ones too, whatever its id; an empty table gives an empty one. Other columns stay, whatever
their names, but for those named ``runs`` or ``collapsed``, which give way to the new ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import beside, map_texts

#: A run has at least so many words and so many periods.
LEAST, POWER = 6, 4
TYPE = "array<struct<start:bigint,length:bigint,period:bigint>>"
_FIELDS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def overlap(least: int = LEAST, power: int = POWER) -> int:
    """How many words a run shares with itself at its own period, at the least: over all periods q, max(least, power q) - q."""
    return min(max(least, power * q) - q for q in range(1, least + 1))


def segments(ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The maximal stretches [start, end) of words inside k-grams that come more than once. Grams are compared by a 64-bit hash: two that collide only leave more to search."""
    n = len(ids) - k + 1
    if n < 2:
        return []
    gram = np.zeros(n, np.uint64)
    for j in range(k):
        gram = gram * _FACTOR + ids[j : j + n].astype(np.uint64) + np.uint64(1)
    order = np.argsort(gram, kind="stable")
    same = gram[order[1:]] == gram[order[:-1]]
    if not same.any():
        return []
    again = np.zeros(n, bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    edge = np.zeros(len(ids) + 1, np.int64)  # +1 where a gram begins, -1 behind its end
    at = np.flatnonzero(again)
    edge[at] += 1
    edge[at + k] -= 1
    inside = np.concatenate(([0], (np.cumsum(edge) > 0).astype(np.int8)))
    turn = np.flatnonzero(np.diff(inside))
    return list(zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True))


def prefixes(w: list) -> list[int]:
    """For each place, how many items from there on equal the first ones; the whole length at 0."""
    n = len(w)
    z, left, right = [0] * n, 0, 0
    if n:
        z[0] = n
    for i in range(1, n):
        m = min(z[i - left], right - i) if i < right else 0
        while i + m < n and w[m] == w[i + m]:
            m += 1
        z[i] = m
        if i + m > right:
            left, right = i, i + m
    return z


def maximal(w: list[int], least: int = LEAST, power: int = POWER) -> dict[tuple[int, int], int]:
    """{(start, end): smallest period} of all runs of ``w``, by halves: a run that lies in no half crosses the middle.

    A run of at least four periods reaches two of them beyond the middle on one side, so periods up to half a half's length are tried there:
    how far the words at the middle and a period on agree, forwards and backwards, are prefix matches. A stretch that
    goes on outside its half was found before, with the whole.
    """
    found: dict[tuple[int, int], int] = {}
    todo, n = [(0, len(w))], len(w)
    while todo:
        lo, hi = todo.pop()
        if hi - lo < least:
            continue
        mid = (lo + hi) // 2
        todo += [(lo, mid), (mid, hi)]
        u, v = w[lo:mid], w[mid:hi]
        back = u[::-1]
        # the part behind the middle holds two periods or more: words i and i + q, to either side of the middle
        reach = len(v) // 2
        if v[0] in v[1 : reach + 1] or u[-1] in v[:reach]:
            ahead, behind = prefixes(v), prefixes(back + [-1] + v[::-1] + back)
            at = len(back) + 1 + len(v)
            for q in range(1, reach + 1):
                after, before = ahead[q], min(behind[at - q], len(u))
                if before and after + before + q >= max(least, power * q):
                    _keep(found, w, n, mid - before, mid + q + after, q)
        reach = len(u) // 2
        if u[-1] in back[1 : reach + 1] or v[0] in back[:reach]:
            ahead, behind = prefixes(v + [-1] + u + v), prefixes(back)
            at = len(v) + 1 + len(u)
            for q in range(1, reach + 1):
                after, before = min(ahead[at - q], len(v)), behind[q]
                if after + before + q >= max(least, power * q):
                    _keep(found, w, n, mid - q - before, mid + after, q)
    return found


def _keep(found: dict, w: list[int], n: int, start: int, end: int, q: int) -> None:
    if (start > 0 and w[start - 1] == w[start - 1 + q]) or (end < n and w[end] == w[end - q]):
        return
    found[start, end] = min(q, found.get((start, end), q))


def runs_of(words: list[bytes], least: int = LEAST, power: int = POWER) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a text's words, by start, then period."""
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(x, len(number)) for x in words), np.int64, len(words))
    runs = []
    for a, b in segments(ids, overlap(least, power)):
        if b - a >= least:
            runs += [(a + s, e - s, q) for (s, e), q in maximal(ids[a:b].tolist(), least, power).items()]
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run holds after its first period, joined by blanks."""
    if not runs:
        return b" ".join(words)
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        drop[start + q] += 1
        drop[start + length] -= 1
    keep = np.cumsum(drop[:-1]) == 0
    return b" ".join([words[i] for i in np.flatnonzero(keep)])


def periodic_runs(df: DataFrame, text: str = "text", least: int = LEAST, power: int = POWER) -> DataFrame:
    """``df`` without ``text``, and ``runs`` (start, length, period; by start, then period, words numbered from 0) and the ``collapsed`` text.

    Words are stretches of bytes that aren't ASCII blanks. ``power`` is at least 4: the search relies on it.
    """
    if power < 4 or least < power:
        raise ValueError("power must be at least 4 and least at least power")
    kept, typed = beside(df.drop(text), "runs", "collapsed")

    def work():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            runs, texts = [], []
            for t in batch.column(batch.num_columns - 1):
                words = t.as_py().encode().split()  # bytes split at blank, tab, line feed, vertical tab, form feed and return
                got = runs_of(words, least, power)
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in got])
                texts.append(collapsed(words, got).decode())
            return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(runs, _FIELDS), pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], "runs", "collapsed"])

        return step

    return map_texts(df, kept, text, work, f"{typed}runs {TYPE}, collapsed string")


def steepest(runs: str | Column = "runs") -> Column:
    """The run with the most periods, compared exactly; of ties the first, then that of least period; null without runs."""
    runs = F.col(runs) if isinstance(runs, str) else runs

    def order(a: Column, b: Column) -> Column:
        more = b["length"] * a["period"] - a["length"] * b["period"]
        return F.signum(F.when(more != 0, more).when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["period"] - b["period"])).cast("int")

    return F.try_element_at(F.array_sort(runs, order), F.lit(1))


def listed(runs: str | Column = "runs") -> Column:
    """``start,length,period`` and a line feed for each run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")


def looped(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The text, of which about one in ten by a checksum of its id loops from a word on with a period, both by that checksum; for tests of the search."""
    h = F.crc32(F.col(doc_id).cast("string"))
    g = F.floor(h / 10)
    found = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    loop = lambda words: F.when(F.size(words) > 0, F.array_join(_looped(words, g), " ")).otherwise("")
    return F.when(h % 10 == 0, F.element_at(F.transform(F.array(found), loop), 1)).otherwise(F.coalesce(F.col(text), F.lit("")))


def _looped(words: Column, g: Column) -> Column:
    n = F.size(words).cast("long")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    return F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))


def duckdb_sql(least: int = LEAST, power: int = POWER) -> str:
    """The rows of ``op12_runs``: stretches of places whose word equals that a lag on, by document and lag, of which the smallest lag counts.

    DuckDB has no CRC-32, so its table is made by rule.
    """
    return rf"""WITH t AS (SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
  h AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(doc_id::VARCHAR, '.'), lambda c: ascii(c)::BIGINT)), lambda c, b: xor(c >> 8, t.t[1 + (xor(c, b) & 255)])), 4294967295) AS h FROM documents, t),
  p AS (SELECT *, len(w) AS n, h // 10 AS g, (h // 10) % greatest(len(w), 1) AS a FROM h),
  d AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE w END AS w FROM p),
  x AS (SELECT doc_id, unnest(w) AS w, unnest(range(n)) AS i FROM d),
  e AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.w = b.w AND b.i > a.i),
  s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e) GROUP BY doc_id, q, island HAVING count(*) + q >= greatest({least}, {power} * q)),
  r AS (SELECT doc_id, start, length, min(q) AS period FROM s GROUP BY ALL),
  m AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM r GROUP BY 1),
  best AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) = 1),
  gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
  c AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS kept FROM x ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
  SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
  FROM d LEFT JOIN m USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN c USING (doc_id)"""
