"""Alphabets: which bytes match, which patterns are valid, and complements."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np

#: Bases that each IUPAC letter stands for; X stands for none.
IUPAC_BASES = {
    "A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "N": "ACGT", "R": "AG", "Y": "CT", "S": "CG", "W": "AT",
    "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "X": "",
}
#: Letters and their complements; others are their own.
IUPAC_PAIRS = ("ACGTRYKMBDHV", "TGCAYRMKVHDB")
DNA_PAIRS = ("ACGT", "TGCA")
_BIT = {"A": 1, "C": 2, "T": 4, "G": 8}


def both_cases(pairs: tuple[str, str]) -> tuple[str, str]:
    return pairs[0] + pairs[0].lower(), pairs[1] + pairs[1].lower()


@dataclass(frozen=True)
class Alphabet:
    """``letters`` are those of valid patterns (None: all bytes); ``pairs`` give complements."""

    name: str
    letters: str | None = None
    pairs: tuple[str, str] | None = None
    overhang: bool = False

    @cached_property
    def codes(self) -> np.ndarray:
        """Bit masks of bytes (IUPAC), or representatives of equal bytes."""
        codes = np.arange(256, dtype=np.uint8)
        if self.name == "ascii_ci":
            codes[65:91] += 32
        elif self.name == "dna":
            codes |= 32
        elif self.name == "iupac":
            by_low_bits = np.full(32, 255, np.uint8)
            for letter, bases in IUPAC_BASES.items():
                by_low_bits[ord(letter) & 31] = sum(_BIT[b] for b in bases)
            codes = by_low_bits[codes & 31]
        return codes

    @cached_property
    def table(self) -> np.ndarray:
        """``table[a, b]``: whether the bytes match."""
        a, b = self.codes[:, None], self.codes[None, :]
        return (a & b) > 0 if self.name == "iupac" else a == b

    @cached_property
    def complements(self) -> np.ndarray:
        if self.pairs is None:
            raise ValueError(f"the alphabet {self.name} has no complement")
        table = np.arange(256, dtype=np.uint8)
        for a, b in zip(*both_cases(self.pairs), strict=True):
            table[ord(a)] = ord(b)
        return table

    def matches(self, a: bytes, b: bytes) -> bool:
        """Whether slices of equal length match byte by byte."""
        if len(a) != len(b):
            raise ValueError("slices differ in length")
        return bool(self.table[np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)].all())

    def valid(self, pattern: bytes) -> bool:
        return self.letters is None or all(chr(c).upper() in self.letters for c in pattern)

    def complement(self, seq: bytes) -> bytes:
        return self.complements[np.frombuffer(seq, np.uint8)].tobytes()

    def reverse_complement(self, seq: bytes) -> bytes:
        return self.complement(seq)[::-1]


ALPHABETS = {
    a.name: a
    for a in (
        Alphabet("ascii"),
        Alphabet("ascii_ci"),
        Alphabet("dna", "ACGT", DNA_PAIRS),
        Alphabet("iupac", "".join(IUPAC_BASES), IUPAC_PAIRS, overhang=True),
    )
}


def alphabet(name: str) -> Alphabet:
    try:
        return ALPHABETS[name]
    except KeyError:
        raise ValueError(f"unknown alphabet {name!r}; there are {', '.join(ALPHABETS)}") from None
