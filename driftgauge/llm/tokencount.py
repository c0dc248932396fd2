"""Token counts with a whole-token shortcut.

Offline, ``proven`` runs the merges of a byte-level BPE vocabulary over each of its own strings and keeps those that
end as one token: once a file, on the driver, from which the list (no longer than the vocabulary) goes to the workers. A text is cut into pre-tokens as the tokenizer's pattern does; a pre-token in the proven set counts
one without any merging, and only the rest is merged, each distinct one once while a bounded memory of counts lasts (of short pre-tokens).

Supported: ``tokenizers`` JSON files with a BPE model and the byte-level pre-tokenizer with its own pattern, no
normalizer and no dropout. Strings of added tokens inside a text are one token each, as the library takes them by
default. Defined results: a null or empty text has no tokens; texts are counted whole, whatever their length; repeated rows count each
for itself; an empty table gives an empty one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import map_texts

#: The byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Counts of merged pre-tokens that a task remembers at once.
REMEMBERED, REMEMBERED_CHARS = 200_000, 64


@cache
def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte: itself where it is printable Latin-1, else the next code point from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Counter:
    """Counts tokens of pre-tokens; built from a vocabulary file and its proven strings, which are worked out where they aren't given."""

    def __init__(self, path: str, whole: list[str] | None = None):
        import regex
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or spec["normalizer"] or model.get("dropout") or pre != pre | {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}:
            raise ValueError(f"not a byte-level BPE vocabulary: {path}")
        self.merge = Tokenizer.from_file(path).model
        self.find = regex.compile(PATTERN).findall
        self.letters = {b: c for b, c in byte_letters().items()}
        self.table = {i: c for i, c in self.letters.items()}
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take in white space or need word ends aren't supported")
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.whole = dict.fromkeys(whole if whole is not None else proven(path), 1)
        self.rest: dict[str, int] = {}

    def merged(self, word: str) -> int:
        n = self.rest.get(word)
        if n is None:
            n = len(self.merge.tokenize("".join([self.letters[b] for b in word.encode()])))
            if len(word) <= REMEMBERED_CHARS:
                if len(self.rest) >= REMEMBERED:
                    self.rest.clear()
                self.rest[word] = n
        return n

    def plain(self, text: str) -> int:
        words = self.find(text)
        rest = [w for w, n in zip(words, map(self.whole.get, words), strict=True) if n is None]
        known = list(map(self.rest.get, rest))
        total = len(words) - len(rest)
        for w, n in zip(rest, known, strict=True):
            total += self.merged(w) if n is None else n
        return total

    def count(self, text: str) -> int:
        if self.added is None or not (found := self.added.findall(text)):
            return self.plain(text)
        return len(found) + sum(map(self.plain, self.added.split(text)))


def prove(vocab: dict[str, int], merges: list[tuple[str, str]]) -> list[str]:
    """The vocabulary strings whose own merges end as one token."""
    rank = {m: i for i, m in enumerate(merges)}
    return [v for v in vocab if len(_bpe(v, rank)) == 1]


@cache
def proven(path: str) -> list[str]:
    """The texts that are one token by themselves, by the merges of a vocabulary file; parts of characters are never pre-tokens and left out."""
    model = json.load(open(path, encoding="utf-8"))["model"]
    back, out = {c: b for b, c in byte_letters().items()}, []
    for piece in prove(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]):
        try:
            out.append(bytes(back[c] for c in piece).decode())
        except (UnicodeDecodeError, KeyError):  # KeyError: an added token that isn't written in byte letters
            continue
    return out


def _bpe(word: str, rank: dict[tuple[str, str], int]) -> list[str]:
    parts = list(word)
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: rank.get((parts[i], parts[i + 1]), 1 << 60))
        if (parts[best], parts[best + 1]) not in rank:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts


_held: dict[str, Counter] = {}


def counter(path: str, whole: list[str]) -> Counter:
    """One per worker process and file."""
    if path not in _held:
        _held.clear()
        _held[path] = Counter(path, whole)
    return _held[path]


def count_tokens(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of each row of ``df``; ``path`` must be readable on every worker."""

    Counter(path, [])  # an unsupported file fails here
    held = df.sparkSession.sparkContext.broadcast(proven(path))

    def work():
        c = counter(path, held.value)

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            texts = part.column(1).to_pylist()
            return pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array([c.count(t) for t in texts], pa.int64())],
                [doc_id, "n_bytes", "n_tokens"],
            )

        return step

    return map_texts(df, [doc_id], text, work, f"`{doc_id}` {df.schema[doc_id].dataType.simpleString()}, n_bytes long, n_tokens long")
