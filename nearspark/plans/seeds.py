"""A filter that Catalyst can run before the kernel sees a row.

If a pattern of length m occurs with at most k edits, one of k + 1 disjoint
pieces of it occurs unchanged.  Rows without any piece hold no match.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from nearspark.plans.options import SearchOptions, pieces

#: Shorter pieces are in almost every text: there are few strings of four bases.
SHORTEST = {"ascii": 4, "ascii_ci": 4, "dna": 8}
MOST_PIECES = 128
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def seed_filter(text: Column, patterns: Sequence[bytes], options: SearchOptions) -> Column | None:
    """Whether a text may hold a match; ``None`` where pieces decide nothing.

    They do not with overhang, with IUPAC letters (which match several), or
    when pieces would be short or many.
    """
    letters = options.letters
    if options.alpha is not None or letters.name == "iupac" or not patterns:
        return None
    wanted = list(patterns)
    if options.rc:
        wanted += [letters.reverse_complement(p) for p in patterns]
    parts = {q for p in wanted for q in pieces(p, options.k)}
    if len(parts) > MOST_PIECES or min(map(len, parts)) < SHORTEST[letters.name]:
        return None
    data = text.cast("binary")
    if letters.name != "ascii":
        data = F.translate(text.cast("string"), _UPPER, _LOWER).cast("binary")
        parts = {p.lower() for p in parts}
    # the text, which may be a costly expression, is computed once for all pieces
    return F.exists(F.array(data), lambda t: reduce(lambda a, b: a | b, (F.contains(t, F.lit(p)) for p in sorted(parts))))
