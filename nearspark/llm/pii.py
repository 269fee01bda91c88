"""Personal data in texts: patterns propose, checksums confirm, context scores.

Regular expressions propose spans.  Validators confirm them: octet ranges for
addresses, Luhn for cards, digit counts for phones, mod-97 for IBANs, reserved
ranges for social security numbers.  Words before a span raise or lower its
score.  The kinds in ``BASE`` are reported whenever their validator passes;
the others when their score also reaches ``min_score``.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from nearspark.llm.batches import map_texts

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
#: Code points before a span in which context words count.
CONTEXT = 40
MIN_SCORE = 0.5

#: Score of a confirmed span, words that raise it, words that lower it.
SCORES = {
    "email": (0.9, r"mail|contact|write|an|correo|courriel", r"example|noreply"),
    "ip": (0.6, r"ip|address|host|server|adresse", r"version|release|section|chapter"),
    "card": (0.8, r"card|visa|credit|karte|tarjeta|carte|payment", r"order|serial|isbn|tracking"),
    "phone": (0.7, r"phone|call|tel|mobile|fax|telefon|tel[ée]fono", r"sum|total|score"),
    "iban": (0.9, r"iban|bank|account|konto|cuenta|compte", r"serial|sample"),
    "ssn": (0.3, r"ssn|social security|tax id|taxpayer", r"order|serial|part|phone"),
}
_CONTEXT = {k: (s, re.compile(rf"\b(?:{up})", re.I), re.compile(rf"\b(?:{down})", re.I)) for k, (s, up, down) in SCORES.items()}

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBERS = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    rest = 0
    for c in iban[4:] + iban[:4]:
        v = int(c, 36)
        rest = (rest * (100 if v > 9 else 10) + v) % 97
    return rest == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each ``@`` outwards.

    The part before ``@`` holds no ``@`` itself, so a match begins where the
    run of its characters does, or where the last match ended.
    """
    found, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            found.append((start, end))
        else:
            end = max(end, at + 1)
        at = text.find("@", max(at + 1, end))
    return found


def addresses(text: str) -> list[tuple[int, int]]:
    small = lambda part: len(part := part.lstrip("0")) <= 3 and int(part or 0) <= 255
    return [m.span() for m in _NUMBERS.finditer(text) if all(map(small, m[0].split(".")))]


def cards(text: str) -> list[tuple[int, int]]:
    found = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(m.span())
    return found


def phones(text: str) -> list[tuple[int, int]]:
    if "+" not in text:
        return []
    return [m.span() for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m[0])) <= 15]


def ibans(text: str) -> list[tuple[int, int]]:
    """From each start, the longest confirmed end among those at blanks; after a failure, from the next start."""
    found, at = [], 0
    while m := _IBAN.search(text, at):
        start, end = m.span()
        while end > start and not (15 <= len(s := text[start:end].replace(" ", "")) <= 34 and mod97(s)):
            end = text.rfind(" ", start, end)
        if end > start:
            found.append((start, end))
        at = max(end, start + 1)
    return found


def ssns(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _SSN.finditer(text) if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000"]


def score(kind: str, text: str, start: int) -> float:
    base, up, down = _CONTEXT[kind]
    before = text[max(0, start - CONTEXT) : start]
    return round(min(1.0, max(0.0, base + 0.3 * bool(up.search(before)) - 0.3 * bool(down.search(before)))), 2)


_FINDERS = {"email": emails, "ip": addresses, "card": cards, "phone": phones, "iban": ibans, "ssn": ssns}


def find_spans(text: str, min_score: float = MIN_SCORE) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind in the order of ``KINDS``, then start."""
    found = []
    for kind in KINDS:
        for a, b in _FINDERS[kind](text):
            s = score(kind, text, a)
            if kind in BASE or s >= min_score:
                found.append((kind, a, b, s))
    return found


def redact(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind in capitals."""
    out, end = [], 0
    for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))):
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


SPANS = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())])
)


def find_pii(df: DataFrame, text_col: str = "text", min_score: float = MIN_SCORE, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all) with pii: array<struct<kind, start, end, score>>.

    Offsets are code points, ``end`` is exclusive.  A null or empty text has an
    empty array; repeated rows are scanned each; an empty table gives an empty
    table; a column named ``pii``, in whatever case, is replaced.  Time is linear in a text's
    length, also for very long runs of digits or of address characters.
    """

    def make():
        def run(texts: pa.Array) -> list:
            return [[[{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in find_spans(t, min_score)] for t in texts.to_pylist()]]

        return run

    return map_texts(df, text_col, [T.StructField("pii", SPANS)], make, keep)


def redact_pii(df: DataFrame, text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """All columns in their order, the text redacted; a null text stays null.

    An empty table gives an empty one; repeated and very long texts are each
    redacted whole; other columns' names do not clash.
    """
    at = [c.lower() for c in df.columns].index(text_col.lower())
    numbered = df.toDF(*[f"c{i}" for i in range(len(df.columns))])

    def make():
        def run(texts: pa.Array, null: pa.Array) -> list:
            return [[None if n else redact(t, find_spans(t, min_score)) for t, n in zip(texts.to_pylist(), null.to_pylist(), strict=True)]]

        return run

    others = [c for i, c in enumerate(numbered.columns) if i != at]
    out = map_texts(numbered, f"c{at}", [T.StructField("redacted", T.StringType())], make, others, extra=[F.col(f"c{at}").isNull()])
    return out.select(*["redacted" if i == at else c for i, c in enumerate(numbered.columns)]).toDF(*df.columns)
