"""Secrets in texts: fixed patterns, and strings that a tokenizer finds costly.

A vocabulary learnt from prose needs few tokens for words and identifiers but
about one for every two characters of a random key.  Strings of
``MIN_LENGTH`` characters or more whose characters-per-token ratio is at most
``max_ratio`` are reported, unless they are digests (hexadecimal strings of a
digest's length), UUIDs, plain numbers, or identifiers made of words.  Such an
identifier is letters and signs with at most four digits at its end, and each
of its parts (between signs, and from a capital to the next in camelCase) has
a ratio above ``max_ratio`` of its own or is one token of two small letters;
other strings of letters are judged like any string.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from nearspark.llm.batches import map_texts
from nearspark.llm.bpe import PIECES

KINDS = ("assign", "access", "hex", "random")
MIN_LENGTH = 20
MAX_RATIO = 2.0

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A | re.I)
_KEYWORD = re.compile(r"passw|secret|token|api_?key", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_STRING = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_LENGTH)
#: Hexadecimal lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
_DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})", re.I)
_UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.I)
_NUMBER = re.compile(r"[0-9_+/=-]+")
_WORDS = re.compile(r"[_/=+-]*[A-Za-z][A-Za-z_/=+-]*[0-9]{0,4}")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@functools.cache
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("secrets", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, leftmost and non-overlapping for each kind."""
    found = []
    if _KEYWORD.search(text):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def of_words(s: str, encode, max_ratio: float = MAX_RATIO) -> bool:
    """Whether the string is an identifier whose parts all are words to the tokenizer."""
    if not _WORDS.fullmatch(s):
        return False
    sizes = ((part, len(encode(part))) for part in _PART.findall(s))
    return all(len(part) > max_ratio * n or (n == 1 and len(part) == 2 and part.islower()) for part, n in sizes)


def random_spans(text: str, encode, taken: list[tuple[int, int, str]], max_ratio: float = MAX_RATIO) -> list[tuple[int, int, str]]:
    """Costly strings that touch none of the spans ``taken``."""
    found = []
    taken = sorted(taken)
    at = 0
    for m in _STRING.finditer(text):
        a, b, s = m.start(), m.end(), m[0]
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if at < len(taken) and taken[at][0] < b:  # spans go by start: if this one lies behind, so do the others
            continue
        if _NUMBER.fullmatch(s) or _DIGEST.fullmatch(s) or _UUID.fullmatch(s):
            continue
        if len(set(s)) > 4 and len(s) <= max_ratio * len(encode(s)) and not of_words(s, encode, max_ratio):
            found.append((a, b, "random"))
    return found


def digest(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())]))


def find_secrets(df: DataFrame, vocabulary: str, text_col: str = "text", max_ratio: float = MAX_RATIO, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all) with secrets: array<struct<start, end, kind>>.

    Offsets are code points, ``end`` is exclusive; spans are ordered by start,
    then by kind in the order of ``KINDS``.  A null or empty text has an empty
    array.  Spans of different fixed kinds may overlap; a costly string is
    reported only where no fixed pattern matched.  Repeated rows are scanned
    each, whole however long they are; an empty table gives an empty one; a
    column named ``secrets``, in whatever case, is replaced.  ``vocabulary`` is a
    ``.tiktoken`` rank file, read on the executors.
    """

    def make():
        encode = _encoder(vocabulary)

        def run(texts: pa.Array) -> list:
            out = []
            for text in texts.to_pylist():
                spans = base_spans(text)
                spans = sorted(spans + random_spans(text, encode, spans, max_ratio), key=lambda s: (s[0], KINDS.index(s[2])))
                out.append([{"start": a, "end": b, "kind": k} for a, b, k in spans])
            return [out]

        return run

    return map_texts(df, text_col, [T.StructField("secrets", SPAN)], make, keep)


def sha256_text(value: str) -> str:
    return hashlib.sha256(value.encode()).hexdigest()
