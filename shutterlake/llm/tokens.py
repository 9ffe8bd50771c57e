"""Encoding of a corpus with a byte-level BPE vocabulary, by speculation and verification.

Greedy longest match proposes the tokens of each distinct word of a batch. A sequence of tokens is what merging by rank would give
if and only if each token is reachable and each adjacent pair is compatible: no merge across their border would come before the merges inside.
All pairs of a batch are tested at once with numpy; only words with an incompatible pair are merged exactly.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published pattern that splits text into words for this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct words that a worker remembers; beyond it the memory starts anew.
REMEMBER = 200_000
_ROW = 1 << 20  # more than any id


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Token bytes -> id of a vocabulary file of lines 'base64 rank'."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines()) if a}


def merge_exactly(word: bytes, ranks: dict[bytes, int], below: int | None = None) -> list[bytes]:
    """Byte-pair merging by rank in O(n log n); ``below`` leaves merges of that rank and later out."""
    n = len(word)
    if n < 2:
        return [word] if n else []
    end, prev = list(range(1, n + 1)), list(range(-1, n - 1))  # piece at i is word[i:end[i]]
    alive = [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = end[i]
        if j < n:
            r = ranks.get(word[i : end[j]])
            if r is not None and (below is None or r < below):
                heapq.heappush(heap, (r, i, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, e = heapq.heappop(heap)
        j = end[i]
        if not alive[i] or j >= n or not alive[j] or end[j] != e:
            continue
        alive[j] = False
        end[i] = e
        if e < n:
            prev[e] = i
        offer(i)
        if prev[i] >= 0:
            offer(prev[i])
    out, i = [], 0
    while i < n:
        out.append(word[i : end[i]])
        i = end[i]
    return out


class Vocabulary:
    """Tables for speculation: the halves of each token, the token of each pair, and which tokens are reachable."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        size = max(ranks.values()) + 1
        self.left, self.right = np.arange(size), np.arange(size)  # a token of one byte has itself as halves
        reachable = set()
        pairs = {}
        for t, r in ranks.items():
            if len(t) == 1:
                reachable.add(t)
                continue
            parts = merge_exactly(t, ranks, r)
            if len(parts) == 2 and parts[0] in ranks and parts[1] in ranks:
                a, b = ranks[parts[0]], ranks[parts[1]]
                self.left[r], self.right[r] = a, b
                pairs[a * _ROW + b] = r
                reachable.add(t)
        self.spoken = {t: ranks[t] for t in reachable}
        k = np.array(sorted(pairs), np.int64)
        self.keys, self.values = k, np.array([pairs[x] for x in k.tolist()], np.int64)
        self.longest: dict[bytes, int] = {}
        for t in reachable:
            self.longest[t[:2]] = max(self.longest.get(t[:2], 1), len(t))

    def combined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token made of each pair, or a value past all ids."""
        if not len(self.keys):
            return np.full(len(a), _ROW)
        k = a * _ROW + b
        i = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where(self.keys[i] == k, self.values[i], _ROW)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens, whether merging would leave the border between them.

        Undo merges on either side, latest first, as long as the pair at the border would not have merged before the merge undone.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        ok = np.ones(len(a), bool)
        limit = np.full(len(a), _ROW)
        todo = np.arange(len(a))
        while len(todo):
            x, y, lim = a[todo], b[todo], limit[todo]
            clash = self.combined(x, y) < lim
            ok[todo[clash]] = False
            todo, x, y = todo[~clash], x[~clash], y[~clash]
            # The later of the two merges is undone. On the right side a border merge of the same rank would come first, from the left.
            go_left = x > y
            nx, ny = np.where(go_left, self.right[x], x), np.where(go_left, y, self.left[y])
            stuck_left, stuck_right = go_left & (nx == x), ~go_left & (ny == y)
            # If the side with the later id is a byte, the other one is undone instead.
            nx = np.where(stuck_right, self.right[x], nx)
            ny = np.where(stuck_left, self.left[y], ny)
            done = (stuck_left & (ny == y)) | (stuck_right & (nx == x))
            new = np.where((go_left & ~stuck_left) | stuck_right, x, y + 1)
            a[todo], b[todo], limit[todo] = nx, ny, new
            todo = todo[~done]
        return ok

    def greedy(self, word: bytes) -> list[int]:
        spoken, longest = self.spoken, self.longest
        one = spoken.get(word)
        if one is not None:
            return [one]
        out, i, n = [], 0, len(word)
        while i < n:
            for e in range(min(n, i + longest.get(word[i : i + 2], 1)), i, -1):
                t = spoken.get(word[i:e])
                if t is not None:
                    out.append(t)
                    i = e
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return out

    def encode_words(self, words: list[str]) -> tuple[list[list[int]], int]:
        """The ids of each word, and how many words had to be merged exactly."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        ids = [self.greedy(w) for w in raw]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((t for x in ids for t in x), np.int64, int(n.sum()))
        owner = np.repeat(np.arange(len(ids)), n)
        inner = owner[1:] == owner[:-1]
        a, b, of = flat[:-1][inner], flat[1:][inner], owner[:-1][inner]
        uniq, back = np.unique(a * _ROW + b, return_inverse=True)
        bad = np.unique(of[~self.compatible(uniq // _ROW, uniq % _ROW)[back]]).tolist()
        for i in bad:
            ids[i] = [self.ranks[p] for p in merge_exactly(raw[i], self.ranks)]
        return ids, len(bad)


_built: dict[str, Vocabulary] = {}


def vocabulary(path: str = VOCABULARY) -> Vocabulary:
    """The tables of a vocabulary file, made once per process."""
    if path not in _built:
        _built[path] = Vocabulary(load_ranks(path))
    return _built[path]


def encoded(docs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN, keep: list[str] | None = None, count_only: bool = False) -> DataFrame:
    """Columns ``keep`` (doc_id by default) with ids (array<int>), or n_tokens (long) if ``count_only``; one row per row of ``docs``.

    No special tokens. Null and empty texts give an empty list (0 tokens). Texts are encoded whole, whatever their length; strings of special
    tokens are ordinary text. Repeated rows and an empty table are kept as they are; other columns are ignored.
    """
    keep = keep or ["doc_id"]
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary(path))  # bounded by the vocabulary file
    result = "n_tokens" if count_only else "ids"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, find, known = shared.value, regex.compile(pattern).findall, {}
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                b = whole.slice(start, 1024)
                words = [find(t) if t else [] for t in b.column(b.num_columns - 1).to_pylist()]
                new = list({w for ws in words for w in ws if w not in known})
                if len(known) + len(new) > REMEMBER:
                    known = {}
                    new = list({w for ws in words for w in ws})
                known.update(zip(new, v.encode_words(new)[0])) if new else None
                if count_only:
                    out = pa.array([sum(len(known[w]) for w in ws) for ws in words], pa.int64())
                else:
                    n = np.fromiter((sum(len(known[w]) for w in ws) for ws in words), np.int64, len(words))
                    ids = np.fromiter((t for ws in words for w in ws for t in known[w]), np.int32, int(n.sum()))
                    out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], out], names=[*keep, result])

    src = docs.select(*keep, F.col("text").alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]), f"{result} {'long' if count_only else 'array<int>'}"])
    return src.mapInArrow(run, schema)
