"""Options of a search, checked once on the driver."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np

from nearspark.functions.alphabets import Alphabet, alphabet

MODES = ("minima", "all", "alignments")
RC_MODES = ("text", "pattern")


@dataclass(frozen=True)
class SearchOptions:
    """How to search.

    alphabet: ``ascii``, ``ascii_ci``, ``dna`` or ``iupac``.
    k: most edits.
    rc: also the reverse complement; ``rc_mode`` ``text`` searches the
        complement in the reversed text, ``pattern`` the reverse complement in
        the text (alignments are then in text direction).
    alpha: cost of each pattern base beyond a text's end, 0 to 1; ``None``: no
        overhang.  max_overhang: most bases that may lie beyond at that cost.
    max_n_frac: largest share of N in a match; ``None`` or 1: any.
    trace: whether starts and CIGARs are found.
    best_only: only the best end of each pattern, text and strand.
    mode: ``minima`` (rightmost ends of local minima), ``all`` (every end) or
        ``alignments`` (every alignment at every end).
    pam: ends must be preceded by this sequence without edits.
    validate: texts with letters outside the alphabet are an error.
    max_per_end, partial, max_cost: in ``alignments`` mode, the most
        alignments of an end, whether unfinished ones count too, and their
        largest cost.
    prune: in ``alignments`` mode, which alignments are not grown further: a
        function of the arrays text_start, pattern_start and cost of those that
        are as far, which gives an array of booleans.
    """

    alphabet: str = "ascii"
    k: int = 0
    rc: bool = False
    rc_mode: str = "text"
    alpha: float | None = None
    max_overhang: int | None = None
    max_n_frac: float | None = None
    trace: bool = True
    best_only: bool = False
    mode: str = "minima"
    pam: bytes | None = None
    validate: bool = False
    max_per_end: int | None = None
    partial: bool = False
    max_cost: int | None = None
    prune: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None = None

    def __post_init__(self):
        letters = self.letters
        if self.k < 0:
            raise ValueError("k must not be negative")
        if self.mode not in MODES or self.rc_mode not in RC_MODES:
            raise ValueError(f"mode is one of {MODES}, rc_mode one of {RC_MODES}")
        if self.rc and letters.pairs is None:
            raise ValueError(f"the alphabet {self.alphabet} has no reverse complement")
        if self.alpha is not None:
            if not letters.overhang:
                raise ValueError(f"the alphabet {self.alphabet} does not support overhang")
            if not 0 <= self.alpha <= 1:
                raise ValueError("alpha must lie between 0 and 1")
            if self.mode == "alignments":
                raise ValueError("all alignments cannot be found with overhang")
        if self.max_overhang is not None and self.max_overhang < 0:
            raise ValueError("max_overhang must not be negative")
        if self.max_n_frac is not None and not 0 <= self.max_n_frac <= 1:
            raise ValueError("max_n_frac must lie between 0 and 1")

    @property
    def letters(self) -> Alphabet:
        return alphabet(self.alphabet)

    def with_(self, **changes) -> SearchOptions:
        return replace(self, **changes)

    def check_pattern(self, pattern: bytes) -> None:
        if not pattern:
            raise ValueError("a pattern is empty")
        if not self.letters.valid(pattern):
            raise ValueError(f"{pattern!r} is no pattern of the alphabet {self.alphabet}")

    def overhang_steps(self, m: int) -> int:
        """Positions beyond a text's end at which a pattern of length ``m`` may end."""
        return overhang_steps(m, self.k, self.alpha, self.max_overhang)

    def left_costs(self, m: int) -> np.ndarray:
        """Cost of the first ``j`` pattern characters before the text, ``j`` from 0 to ``m``."""
        j = np.arange(m + 1)
        if self.alpha is None:
            return j
        within = j if self.max_overhang is None else np.minimum(j, self.max_overhang)
        return np.floor(within.astype(np.float32) * np.float32(self.alpha)).astype(np.int64) + (j - within)

    def right_costs(self, beyond: np.ndarray) -> np.ndarray:
        """Cost of ``beyond`` pattern characters after the text."""
        if self.alpha is None:
            return np.zeros(len(beyond), np.int64)
        return np.floor(np.float32(self.alpha) * beyond.astype(np.float32)).astype(np.int64)


def pieces(pattern: bytes, k: int) -> list[bytes]:
    """``k + 1`` disjoint pieces of nearly equal length; one is unchanged after ``k`` edits."""
    m = len(pattern)
    cuts = [m * i // (k + 1) for i in range(k + 2)]
    return [pattern[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def overhang_steps(m: int, k: int, alpha: float | None, max_overhang: int | None = None) -> int:
    if alpha is None:
        return 0
    a = np.float32(alpha)
    steps = m if a == 0 else min(m, int(np.ceil((np.float32(k) + a) / a)))
    return steps if max_overhang is None else min(steps, max_overhang)


def fractional_k(pattern_length: int, k: float) -> int:
    """``k`` itself from 1 on; below that a share of the pattern's length, rounded up."""
    return int(k) if k >= 1 else int(np.ceil(pattern_length * k))
