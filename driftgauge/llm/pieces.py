"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

``load`` reads a ``.model`` file. A unigram file's scores are log probabilities; a BPE file only has the order of its
merges, so its pieces get log scores by Zipf's law, -ln(order + 2), rounded to 1/256 so that sums are exact. The text
is marked (a blank becomes U+2581, one goes before the text if the file says so) and cut before each run of marks: no
piece has a mark behind another character (checked when loading), so the best paths of the parts make the best path
of the whole. Distinct parts are encoded once, many at a time: the trie is walked from all their characters in step.
A character without a piece costs the least score less 10 and becomes its bytes' pieces, if the file has byte fallback,
else the unknown piece. Of equal paths the one whose last piece is longest wins, as the public library has it.

Defined results: a null or empty text has no pieces and decodes to an empty text; texts are encoded whole. Decoding is
exact but for U+2581 in a text, which reads as a blank (as the public library has it), and for unknown pieces. Repeated rows
count each for itself; an empty table gives an empty one; other columns stay, but for those named like a new one, which give way to it.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import beside, map_texts, ship

MARK = "▁"
#: Kinds of piece in a model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
PENALTY = 10.0
#: Parts of texts that a task remembers at once, and their characters together.
REMEMBERED, REMEMBERED_CHARS = 120_000, 2_000_000
#: Rows and ids decoded at once.
DECODED_ROWS, DECODED_IDS = 512, 1 << 18


def _fields(data: bytes):
    """The (number, value) fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 0x7F) << shift
            if b < 0x80:
                return n
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 5:
            at += 4
            yield tag >> 3, data[at - 4 : at]
        elif kind == 1:
            at += 8
            yield tag >> 3, data[at - 8 : at]
        else:
            n = varint()
            at += n
            yield tag >> 3, data[at - n : at]


def double_array(words: dict[str, int], code: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, value) of a trie over dense character codes from 1 on; value is -1 where no word ends."""
    root: dict = {}
    for w, v in words.items():
        node = root
        for ch in w:
            node = node.setdefault(code[ch], {})
        node[0] = v
    size = 4 * len(words) + 2 * len(code) + 1024
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    check[0] = 0
    free, top = 1, 1
    todo = [(root, 0)]
    while todo:
        node, at = todo.pop()
        keys = np.array(sorted(k for k in node if k), np.int64)
        value[at] = node.get(0, -1)
        if not len(keys):
            continue
        if free + 3 * len(code) + 1024 > len(base):
            base, check, value = (np.concatenate((a, np.full(len(a), f, np.int32))) for a, f in ((base, 0), (check, -1), (value, -1)))
        while check[free] >= 0:
            free += 1
        b, tries = max(1, free - int(keys[0])), 0
        while True:
            if b + int(keys[-1]) >= len(base):
                base, check, value = (np.concatenate((a, np.full(len(a), f, np.int32))) for a, f in ((base, 0), (check, -1), (value, -1)))
            if (check[b + keys] < 0).all():
                break
            b, tries = b + 1, tries + 1
            if tries == 48:  # the dense part is full for this node: on behind all that is in use
                b = max(b, top + 1 - int(keys[0]))
        base[at] = b
        check[b + keys] = at
        top = max(top, b + int(keys[-1]))
        if tries >= 48:
            free += 8
        todo += [(node[int(k)], b + int(k)) for k in keys]
    return base, check, value


@dataclass
class Model:
    pieces: list[str]
    kinds: list[int]
    scores: np.ndarray
    unknown: int
    byte_ids: list[int] | None
    prefix: bool
    code: dict[str, int]
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    longest: int

    def __post_init__(self) -> None:
        self.memory: dict[str, bytes] = {}
        self.held = 0
        self.code_of = np.zeros(max(map(ord, self.code)) + 2, np.int64)
        for ch, i in self.code.items():
            self.code_of[ord(ch)] = i
        self.shown = [p if k in (NORMAL, USER, UNUSED) else "" for p, k in zip(self.pieces, self.kinds, strict=True)]
        self.least = float(min((s for s, k in zip(self.scores, self.kinds, strict=True) if k == NORMAL), default=0.0))
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids or [])}
        self.cut = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall
        self.plain = np.array([i not in self.byte_of and i != self.unknown for i in range(len(self.pieces))])

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k in self.__dataclass_fields__}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    # encoding
    def parts(self, text: str) -> list[str]:
        if not text:
            return []
        marked = text.replace(" ", MARK)
        return self.cut(MARK + marked if self.prefix else marked)

    def full(self, words) -> bool:
        return len(self.memory) + len(words) > REMEMBERED or self.held + sum(map(len, words)) > REMEMBERED_CHARS

    def learn(self, words: list[str]) -> None:
        """Puts the best paths of distinct parts into the memory."""
        long = np.array([len(w) for w in words])
        order = np.argsort(-long, kind="stable")
        words, long = [words[i] for i in order], long[order]
        start = np.concatenate(([0], np.cumsum(long)[:-1]))
        total = int(long.sum())
        text = "".join(words)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(points < len(self.code_of), self.code_of[np.minimum(points, len(self.code_of) - 1)], 0)
        left = np.repeat(start + long, long) - np.arange(total)
        # gain[k - 1, e]: the score of the piece of k characters that ends with character e
        gain = np.full((self.longest, total), -np.inf)
        which = np.full((self.longest, total), -1, np.int32)
        at, node = np.arange(total), np.zeros(total, np.int64)
        for k in range(min(self.longest, int(long[0]))):
            at, node = (a[left[at] > k] for a in (at, node))
            nxt = self.base[node] + codes[at + k]
            ok = (codes[at + k] > 0) & (nxt < len(self.check)) & (self.base[node] > 0)
            ok[ok] = self.check[nxt[ok]] == node[ok]
            at, node = at[ok], nxt[ok]
            if not len(at):
                break
            v = self.value[node]
            hit = v >= 0
            gain[k, at[hit] + k] = self.scores[v[hit]]
            which[k, at[hit] + k] = v[hit]
        lone = which[0] < 0
        gain[0, lone] = self.least - PENALTY
        took = np.zeros(total, np.int32)
        best_end = np.full(total, -np.inf)
        for e in range(int(long[0])):
            n = int(np.searchsorted(-long, -e, side="left"))  # parts longer than e
            here = start[:n] + e
            top, arg = np.full(n, -np.inf), np.zeros(n, np.int32)
            for k in range(min(self.longest, e + 1), 0, -1):
                before = best_end[here - k] if e >= k else 0.0
                c = before + gain[k - 1, here]
                better = c > top
                top[better] = (c if np.ndim(c) else np.full(n, c))[better]
                arg[better] = k
            best_end[here], took[here] = top, arg
        if self.full(words):
            self.memory.clear()
            self.held = 0
        self.held += total
        # from the ends back, all parts in step: first how many pieces, then which
        path, e, alive, n = [], start + long - 1, np.arange(len(words)), np.zeros(len(words), np.int64)
        while len(alive):
            k = took[e[alive]]
            path.append((alive, which[k - 1, e[alive]]))
            n[alive] += 1
            e[alive] -= k
            alive = alive[e[alive] >= start[alive]]
        last = np.cumsum(n)
        at, flat, odd = last - 1, np.zeros(int(last[-1]), np.int32), np.zeros(len(words), bool)
        for who, ids in path:
            flat[at[who]] = ids
            at[who] -= 1
            odd[who] |= ids < 0
        raw = flat.tobytes()
        for w, b, c, o in zip(words, (4 * last).tolist(), (4 * n).tolist(), odd.tolist(), strict=True):
            self.memory[w] = raw[b - c : b] if not o else b""
        for w in np.flatnonzero(odd).tolist():
            first, i = int(start[w]), int(start[w] + long[w] - 1)
            ids = []
            while i >= first:
                k = int(took[i])
                if (piece := int(which[k - 1, i])) >= 0:
                    ids.append(piece)
                else:
                    ids += [self.byte_ids[b] for b in reversed(text[i].encode())] if self.byte_ids else [self.unknown]
                i -= k
            self.memory[words[w]] = np.array(ids[::-1], np.int32).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.parts(t) for t in texts]
        new = {w for c in cut for w in c if w not in self.memory}
        got: dict[str, bytes] = self.memory
        if new:
            known = {w: b for c in cut for w in c if (b := self.memory.get(w)) is not None} if self.full(new) else {}
            held, batch = 0, []
            for w in sorted(new, key=len):
                if batch and held + len(w) > 40_000:
                    self.learn(batch)
                    known |= {x: self.memory[x] for x in batch} if known else {}
                    held, batch = 0, []
                batch.append(w)
                held += len(w)
            self.learn(batch)
            got = known | {x: self.memory[x] for x in batch} if known else self.memory
            if any(w not in got for w in new):  # the memory was emptied on the way
                got = dict(got)
                for w in new:
                    if w not in got:
                        self.learn([w])
                        got[w] = self.memory[w]
        return [np.frombuffer(b"".join(map(got.__getitem__, c)), np.int32) for c in cut]

    # decoding
    def decode(self, ids: np.ndarray) -> str:
        if not len(ids):
            return ""
        shown = self.shown
        if self.plain[ids].all():
            text = "".join([shown[i] for i in ids.tolist()])
        else:
            out, held = [], bytearray()
            for i in ids.tolist():
                if i in self.byte_of:
                    held.append(self.byte_of[i])
                    continue
                if held:
                    out.append(held.decode("utf-8", "replace"))
                    held.clear()
                out.append(" ⁇ " if i == self.unknown else shown[i])
            if held:
                out.append(held.decode("utf-8", "replace"))
            text = "".join(out)
        text = text.replace(MARK, " ")
        return text[1:] if self.prefix and text[:1] == " " else text


def load(path: str) -> Model:
    return build(open(path, "rb").read())


def build(data: bytes) -> Model:
    pieces, scores, kinds, trainer, normal = [], [], [], {}, {}
    for n, v in _fields(data):
        if n == 1:
            f = dict(_fields(v))
            pieces.append(f.get(1, b"").decode())
            scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
            kinds.append(f.get(3, NORMAL))
        elif n == 2:
            trainer = dict(_fields(v))
        elif n == 3:
            normal = dict(_fields(v))
    if normal.get(2) or normal.get(4, 1) and normal.get(1) != b"identity":
        raise ValueError("only files with the identity normalizer that keep white space are supported")
    own = [i for i, k in enumerate(kinds) if k in (NORMAL, USER)]
    if trainer.get(3, 1) == 2:
        order = {i: n for n, i in enumerate(own)}
        scores = [-round(256 * float(np.log(order[i] + 2))) / 256 if i in order else 0.0 for i in range(len(pieces))]
    most = max((scores[i] for i in own if kinds[i] == NORMAL), default=0.0)
    for i in own:
        if kinds[i] == USER:
            scores[i] = len(pieces[i].encode()) * most - 0.1
    words = {pieces[i]: i for i in own if pieces[i]}
    if any(MARK in w.lstrip(MARK) for w in words):
        raise ValueError("a piece has a white-space mark behind another character")
    code = {ch: i for i, ch in enumerate(sorted({ch for w in words for ch in w}), 1)}
    at_byte = {p: i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == BYTE}
    byte_ids = [at_byte[f"<0x{b:02X}>"] for b in range(256)] if len(at_byte) == 256 else None
    return Model(pieces, kinds, np.array(scores), kinds.index(UNKNOWN), byte_ids, bool(normal.get(3, 1)), code, *double_array(words, code), max(map(len, words)))


def _list(ids: list[np.ndarray]) -> pa.ListArray:
    at = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32()))


def encode(df: DataFrame, model: Model, text: str = "text", column: str = "ids") -> DataFrame:
    """All columns of ``df``, then the ids of the text's pieces, in place of a column of that name."""
    keep, kept = beside(df, column)
    held = df.sparkSession.sparkContext.broadcast(model)  # a vocabulary: its size doesn't grow with the data

    def work():
        m = held.value

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*part.columns[:-1], _list(m.encode(part.column(part.num_columns - 1).to_pylist()))], [*keep, column])

        return step

    return map_texts(df, keep, text, work, f"{kept}`{column}` array<int>")


def decode(df: DataFrame, model: Model, column: str = "ids", decoded: str = "decoded") -> DataFrame:
    """All columns of ``df``, then the text that its ids stand for; null ids give an empty text."""
    ship()
    names, kept = beside(df, decoded)
    df = df.select(*[F.col(c) for c in names])
    at = names.index(column)
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        for batch in batches:
            size = pc.fill_null(pc.list_value_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
            block = np.maximum(np.cumsum(size) // DECODED_IDS, np.arange(len(size)) // DECODED_ROWS) if len(size) else size
            edges = np.concatenate(([0], np.flatnonzero(np.diff(np.maximum.accumulate(block))) + 1, [len(size)])) if len(size) else [0]
            for a, b in zip(edges, edges[1:], strict=False):
                part = batch.slice(int(a), int(b - a))
                texts = [m.decode(x.values.to_numpy() if x.is_valid else np.zeros(0, np.int32)) for x in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, decoded])

    return df.mapInArrow(run, f"{kept}`{decoded}` string")
