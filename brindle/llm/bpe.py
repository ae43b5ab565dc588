"""Problem 8: encoding a corpus with a public byte-level BPE vocabulary.

``BpeEncoder`` reproduces the merges of the vocabulary exactly, in time linear in the text, without applying merges:

* the vocabulary becomes an Aho-Corasick automaton over Latin-1 strings (one character for each byte), which gives the
  longest token that starts at each position of a piece;
* a piece is encoded by taking longest matches and backtracking: a token may follow another only if BPE would keep the
  two apart (``compatible``, memoised for each adjacent pair); if not, the next shorter token is tried, and if none is
  left the last token is taken back. A position that was found to be a dead end is never entered again, which bounds
  the work by the length of the piece.

Pieces come from the vocabulary's pre-tokenisation pattern; the ids of short pieces are remembered in a bounded cache.

Defined results: a null and an empty text give an empty list; special tokens are never produced, their strings are
ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from brindle.llm.common import chunks, spread

#: The pre-tokenisation pattern of the vocabulary (a fixed value of its public definition).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Remembered pieces, and the length up to which a piece is remembered.
CACHE_PIECES, CACHE_CHARS = 300_000, 40


class _Pieces(dict):
    """Ids of pieces; a short piece is remembered."""

    def __init__(self, owner: BpeEncoder) -> None:
        self._owner = owner

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self._owner._piece(piece.encode("utf-8").decode("latin-1"))
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class BpeEncoder:
    """Encoder of one vocabulary; build it once in a process (``encoder``)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        self.split = regex.compile(pattern).findall
        self.ids = {token.decode("latin-1"): i for token, i in ranks.items()}
        self.size = {i: len(t) for t, i in self.ids.items()}
        self._memo: dict[tuple[int, int], bool] = {}
        self._pieces = _Pieces(self)
        self._shorter = self._prefixes()
        self._parts: dict[int, tuple[int, int]] = {}
        self._merged: dict[tuple[int, int], int] = {}
        self._learn_merges()
        self._auto = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self._auto.add_word(t, (i, len(t)))
        self._auto.make_automaton()

    def _prefixes(self) -> dict[int, int | None]:
        """For each token the longest token that is a proper prefix of it."""
        out: dict[int, int | None] = {}
        for t, i in self.ids.items():
            out[i] = next((self.ids[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.ids), None)
        return out

    def _learn_merges(self) -> None:
        """The two tokens each token is merged from, in the order of the ranks."""
        for t, i in sorted(self.ids.items(), key=lambda x: x[1]):
            self._parts[i] = (i, i)
            left = self._shorter[i]
            while left is not None:
                right = self.ids.get(t[self.size[left] :])
                if right is not None and left < i and right < i and self._compatible(left, right):
                    self._parts[i], self._merged[left, right] = (left, right), i
                    break
                left = self._shorter[left]
        self._memo.clear()

    def _compatible(self, a: int, b: int) -> bool:
        """Whether BPE leaves the tokens ``a`` and ``b`` side by side, by undoing their merges from the latest on."""
        limit = 1 << 62
        while True:
            merged = self._merged.get((a, b))
            if merged is not None and merged < limit:
                return False
            if a > b:
                limit, a = a, self._parts[a][1]
                if a == limit:
                    limit, b = b + 1, self._parts[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, self._parts[b][0]
                if b + 1 == limit:
                    limit, a = a, self._parts[a][1]
                    if a == limit:
                        return True

    def compatible(self, a: int, b: int) -> bool:
        known = self._memo.get((a, b))
        if known is None:
            if len(self._memo) > 2_000_000:
                self._memo.clear()
            known = self._memo[a, b] = self._compatible(a, b)
        return known

    def _piece(self, s: str) -> tuple[int, ...]:
        """Ids of one piece, given as a Latin-1 string of its bytes."""
        whole = self.ids.get(s)
        if whole is not None and self._is_own_encoding(whole):
            return (whole,)
        n = len(s)
        longest: list[int] = [-1] * n
        reach = [0] * n
        for end, (i, k) in self._auto.iter(s):
            start = end - k + 1
            if k > reach[start]:
                reach[start], longest[start] = k, i
        open_at = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        pos, token = 0, longest[0]
        while True:
            last, candidate, end = out[-1] if out else None, token, 0
            while candidate is not None:
                end = pos + self.size[candidate]
                if open_at[end] and (last is None or self.compatible(last, candidate)):
                    break
                candidate = self._shorter[candidate]
            if candidate is None:
                open_at[pos] = 0
                token = out.pop()
                pos -= self.size[token]
                continue
            out.append(candidate)
            pos = end
            if pos == n:
                return tuple(out)
            token = longest[pos]

    def _is_own_encoding(self, i: int) -> bool:
        return self._parts[i][0] != i or self.size[i] == 1

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        return list(chain.from_iterable(map(self._pieces.__getitem__, self.split(text))))


@lru_cache(maxsize=2)
def encoder(path: str = DEFAULT_RANKS) -> BpeEncoder:
    """The encoder of a file of base64 tokens and ranks; one for each Python worker."""
    with open(path, "rb") as f:
        return BpeEncoder({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = DEFAULT_RANKS) -> DataFrame:
    """``id_col, ids array<int>``: one row for each row of ``df``. A single pass without a shuffle."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in chunks(batches):
            ids = [enc.encode(t) for t in b.column(1).to_pylist()]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            flat = np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[id_col, "ids"])

    return spread(df.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = DEFAULT_RANKS) -> DataFrame:
    """``id_col, tokens``: the length of each encoding, without moving the ids to the JVM."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in chunks(batches):
            n = np.fromiter((len(enc.encode(t)) for t in b.column(1).to_pylist()), dtype=np.int64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n)], names=[id_col, "tokens"])

    return spread(df.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {kind}, tokens bigint")
