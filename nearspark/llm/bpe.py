"""Token counts by byte-pair merging with a heap over a linked list.

Each piece of text starts as a chain of byte symbols.  A heap holds the
adjacent pairs that have a merge rank; the pair of lowest rank (leftmost among
equals) is popped, its right symbol is unlinked, and the two pairs that the
merge creates are pushed.  The count is the number of initial symbols less the
number of merges; no identifiers are produced.
"""

from __future__ import annotations

import base64
import functools
import json
import re
from collections.abc import Callable
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, types as T

from nearspark.llm.batches import map_texts

#: The pattern that splits text before byte-level merges.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pieces whose counts a process remembers at most.
REMEMBERED = 1_000_000


def _byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabulary files."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shown = {b: chr(b) for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in shown):
        shown[b] = chr(256 + i)
    return {c: b for b, c in shown.items()}


class PairMerger:
    """Merge ranks of a vocabulary, and the token count of a piece of bytes.

    A pair of symbols is the number ``left << 32 | right``; ``ranks`` has its
    rank and ``merged`` what each rank's pair becomes.
    """

    def __init__(self, ranks: dict[int, int], merged: dict[int, int], initial: list[int], special: list[str]):
        self.ranks = ranks
        self.merged = merged
        self.initial = initial
        self.special = special

    @classmethod
    def load(cls, path: str) -> PairMerger:
        """From a byte-level ``.json`` tokenizer or a ``.tiktoken`` rank file."""
        if path.endswith(".json"):
            with open(path, encoding="utf-8") as file:
                spec = json.load(file)
            model, pre = spec["model"], spec.get("pre_tokenizer") or {}
            if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
                raise ValueError(f"{path} is not a plain byte-level BPE tokenizer")
            vocab = model["vocab"]
            initial = [0] * 256
            for shown, byte in _byte_symbols().items():
                initial[byte] = vocab[shown]
            ranks, merged = {}, {}
            for rank, pair in enumerate(model["merges"]):
                left, right = pair.split(" ") if isinstance(pair, str) else pair
                ranks[vocab[left] << 32 | vocab[right]] = rank
                merged[rank] = vocab[left + right]
            return cls(ranks, merged, initial, [t["content"] for t in spec.get("added_tokens", [])])
        if path.endswith(".tiktoken"):
            with open(path, "rb") as file:
                order = {base64.b64decode(line.split()[0]): int(line.split()[1]) for line in file if line.strip()}
            initial = [order[bytes([b])] for b in range(256)]
            ranks = {}
            for token, rank in order.items():
                for cut in range(1, len(token)):
                    left, right = order.get(token[:cut]), order.get(token[cut:])
                    if left is not None and right is not None:
                        ranks[left << 32 | right] = rank
            return cls(ranks, {r: r for r in order.values()}, initial, [])
        raise ValueError(f"no reader for the vocabulary {path}")

    def count(self, piece: bytes) -> int:
        n = len(piece)
        if n < 2:
            return n
        initial, rank_of, merged = self.initial, self.ranks.get, self.merged
        symbols = [initial[b] for b in piece]
        heap = []
        left = symbols[0]
        for i in range(1, n):
            right = symbols[i]
            if (rank := rank_of(left << 32 | right)) is not None:
                heap.append(rank << 32 | i - 1)
            left = right
        if not heap:
            return n
        heapify(heap)
        following = list(range(1, n + 1))
        previous = list(range(-1, n - 1))
        merges = 0
        while heap:
            entry = heappop(heap)
            i, rank = entry & 0xFFFFFFFF, entry >> 32
            j = following[i]
            if j >= n or symbols[i] < 0 or rank_of(symbols[i] << 32 | symbols[j]) != rank:
                continue  # one of the two has been merged meanwhile
            merges += 1
            symbols[i] = new = merged[rank]
            symbols[j] = -1
            following[i] = k = following[j]
            if k < n:
                previous[k] = i
                if (rank := rank_of(new << 32 | symbols[k])) is not None:
                    heappush(heap, rank << 32 | i)
            if (h := previous[i]) >= 0 and (rank := rank_of(symbols[h] << 32 | new)) is not None:
                heappush(heap, rank << 32 | h)
        return n - merges


class _Remembered(dict):
    """Counts of pieces; what was not asked for again goes when it is full."""

    def __init__(self, merger: PairMerger, most: int):
        super().__init__()
        self.merger, self.most, self.older = merger, most, {}

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.most // 2:
            self.older = dict(self)
            self.clear()
        n = self.older.get(piece)
        if n is None:
            n = self.merger.count(piece.encode())
        self[piece] = n
        return n


#: Beyond this code point texts are split by ``PIECES`` itself.
_LATIN = 0x250


def _splitter() -> Callable[[str], list[str]]:
    """``findall`` of ``PIECES``, by the faster engine where its classes are few.

    For texts of code points below ``_LATIN`` the classes are spelled out for
    the standard engine; both give the same pieces.
    """
    general = regex.compile(PIECES).findall

    def spelled(kind: str) -> str:
        return "".join(re.escape(c) for c in map(chr, range(_LATIN)) if regex.fullmatch(kind, c))

    letters, digits, blanks = spelled(r"\p{L}"), spelled(r"\p{N}"), spelled(r"\s")
    pattern = PIECES.replace(r"[^\s\p{L}\p{N}]", f"[^{blanks}{letters}{digits}]").replace(r"\p{L}", f"[{letters}]")
    pattern = pattern.replace(r"\p{N}", f"[{digits}]").replace(r"\s+(?!\S)", f"[{blanks}]+(?![^{blanks}])").replace(r"\s+", f"[{blanks}]+")
    latin = re.compile(pattern).findall
    beyond = re.compile(f"[^\\x00-{chr(_LATIN - 1)}]").search

    def split(text: str) -> list[str]:
        return latin(text) if text.isascii() or not beyond(text) else general(text)

    return split


@functools.cache
def counter(path: str, remembered: int = REMEMBERED) -> Callable[[str], int]:
    """A function from a text to its number of tokens; one for each process."""
    merger = PairMerger.load(path)
    known = _Remembered(merger, remembered)
    find = _splitter()
    special = regex.compile("|".join(map(regex.escape, merger.special))) if merger.special else None

    def count(text: str) -> int:
        if special is None or not special.search(text):
            return sum(map(known.__getitem__, find(text)))
        parts = special.split(text)
        return len(parts) - 1 + sum(sum(map(known.__getitem__, find(part))) for part in parts)

    return count


def count_tokens(df: DataFrame, vocabulary: str, text_col: str = "text", limit: int = 1024, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all) with n_bytes, n_tokens and over_limit.

    A null or empty text has 0 bytes and 0 tokens.  Special strings that the
    vocabulary declares count as one token wherever they stand in a text.
    Repeated rows are counted each; an empty table gives an empty table.
    Columns of the same names as the results are replaced.  ``vocabulary`` is
    read on the executors, once for each task.
    """
    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]

    def make():
        count = counter(vocabulary)

        def run(texts: pa.Array) -> list:
            plain = texts.to_pylist()
            tokens = [count(t) for t in plain]
            return [[len(t.encode()) for t in plain], tokens, [n > limit for n in tokens]]

        return run

    return map_texts(df, text_col, fields, make, keep)
