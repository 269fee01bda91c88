"""Matches as lines of text, with or without colours.

Matching characters are green, substitutions yellow, characters of the text
alone cyan, characters of the pattern alone red.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from nearspark.functions.alphabets import alphabet

STYLES = ("compact", "full", "line")
DIRECTIONS = ("pattern", "text")
#: Characters to either side in the style ``line``, at most.
LINE_CONTEXT = 50
_CODES = {"green": "32", "yellow": "33", "cyan": "36", "red": "31", "bold": "1", "dim": "2"}


def _paint(text: str, styles: str, colour: bool) -> str:
    if not colour or not text:
        return text
    return f"\x1b[{';'.join(_CODES[s] for s in styles.split())}m{text}\x1b[0m"


def _aligned(pattern: bytes, region: bytes, cigar: list[tuple[int, str]], colour: bool) -> tuple[int, str]:
    out, length, i, j = [], 0, 0, 0
    for n, (count, op) in enumerate(cigar):
        outer = n in (0, len(cigar) - 1)
        for _ in range(count):
            length += 1
            if op == "I":
                out.append(_paint(chr(pattern[j]), "red" if outer else "red bold", colour))
                j += 1
                continue
            out.append(_paint(chr(region[i]), {"=": "green", "X": "yellow bold", "D": "cyan bold"}[op], colour))
            i += 1
            j += op != "D"
    return length, "".join(out)


def render(pattern: bytes, text: bytes, match: dict, pattern_id: str = "", style: str = "full", direction: str = "text", context: int = 20, colour: bool = True) -> str:
    """One traced match as a line; ``match`` has the columns of a match."""
    if style not in STYLES or direction not in DIRECTIONS:
        raise ValueError(f"style is one of {STYLES}, direction one of {DIRECTIONS}")
    start, end, p1, p2 = (match[c] for c in ("text_start", "text_end", "pattern_start", "pattern_end"))
    cigar = [(int(n), op) for n, op in re.findall(r"([0-9]+)([=XDI])", match["cigar"])]
    if match["strand"] == "-":
        flip = alphabet("iupac").reverse_complement
        if direction == "pattern":
            text = flip(text)
            start, end = len(text) - end, len(text) - start
        else:
            pattern = flip(pattern)
            p1, p2 = len(pattern) - p2, len(pattern) - p1
            cigar.reverse()
    cigar = [(p1, "I")] * (p1 > 0) + cigar + [(len(pattern) - p2, "I")] * (p2 < len(pattern))
    length, middle = _aligned(pattern, text[start:end], cigar, colour)
    show = lambda b: b.decode("utf-8", "replace")
    cost = _paint(f"{match['cost']:>2}", "bold", colour)
    if style == "line":
        a = max(text.rfind(b"\n", 0, start) + 1, start - LINE_CONTEXT)
        stop = text.find(b"\n", end)
        b = min(len(text) if stop < 0 else stop, end + LINE_CONTEXT)
        place = _paint(f"{start:<{len(str(max(1, len(text))))}}", "dim", colour)
        return f"{place}: {cost} | {show(text[a:start])}{middle}{show(text[end:b])}"
    before = text[max(0, start - context) : start]
    room = max(0, context - (length - len(pattern)))  # the middle may be longer than the pattern
    after = text[end : end + room]
    strand = _paint(match["strand"], "bold", colour)
    if style == "compact":
        return f"{strand} {cost} | {show(before):>{context}}{middle}{show(after)}"
    skipped = [start - len(before), len(text) - end - len(after)]
    left = f"{skipped[0]:>9} bp + " if skipped[0] else " " * 15
    right = f" + {skipped[1]:>9} bp" if skipped[1] else " " * 15
    span = _paint(f"{start}-{end}".ljust(19), "dim", colour)
    return f"{pattern_id} ({strand}) {cost} | {_paint(left, 'dim', colour)}{show(before):>{context}}{middle}{show(after)}{' ' * (room - len(after))}{_paint(right, 'dim', colour)} @ {span}"


def pretty(matches: DataFrame, patterns: dict[str, bytes], text_col: str = "seq", column: str = "pretty", **how) -> DataFrame:
    """Matches with a rendered line; ``patterns`` are by pattern_id."""
    schema = T.StructType([*matches.schema, T.StructField(column, T.StringType())])
    needed = ("text_start", "text_end", "pattern_start", "pattern_end", "cost", "strand", "cigar")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = []
            for row in batch.select([*needed, "pattern_id", text_col]).to_pylist():
                text = row[text_col]
                lines.append(render(patterns[row["pattern_id"]], text.encode() if isinstance(text, str) else text, row, row["pattern_id"], **how))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lines, pa.string())], names=schema.names)

    return matches.mapInArrow(run, schema)
