"""Column functions on sequences, matches and CIGARs; all run in the JVM."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F

from nearspark.functions.alphabets import alphabet, both_cases

ColumnOrName = Column | str


def _c(value: ColumnOrName) -> Column:
    return F.col(value) if isinstance(value, str) else value


def complement(seq: ColumnOrName, letters: str = "iupac") -> Column:
    pairs = alphabet(letters).pairs
    if pairs is None:
        raise ValueError(f"the alphabet {letters} has no complement")
    return F.translate(_c(seq), *both_cases(pairs))


def reverse_complement(seq: ColumnOrName, letters: str = "iupac") -> Column:
    return F.reverse(complement(seq, letters))


def reverse_text(seq: ColumnOrName) -> Column:
    return F.reverse(_c(seq))


def valid_seq(seq: ColumnOrName, letters: str = "iupac") -> Column:
    """Whether all characters belong to the alphabet; an empty sequence is valid."""
    known = alphabet(letters).letters
    return F.lit(True) if known is None else _c(seq).rlike(f"^[{known}{known.lower()}]*\\z")


def encode_char(char: ColumnOrName, letters: str = "iupac") -> Column:
    """The code of a character: a mask of bases (IUPAC), else a number that equal characters share."""
    code = F.ascii(_c(char))
    if letters == "iupac":
        table = alphabet("iupac").codes[64:96]
        return F.element_at(F.array(*[F.lit(int(x)) for x in table]), code.bitwiseAND(31) + 1)
    if letters == "dna":
        return code.bitwiseOR(32)
    return F.ascii(F.lower(_c(char))) if letters == "ascii_ci" else code


def is_match(a: ColumnOrName, b: ColumnOrName, letters: str = "iupac") -> Column:
    one, two = encode_char(a, letters), encode_char(b, letters)
    return one.bitwiseAND(two) > 0 if letters == "iupac" else one == two


def is_match_slice(a: ColumnOrName, b: ColumnOrName, letters: str = "iupac") -> Column:
    """Whether two ASCII sequences match character by character; null if their lengths differ."""
    one, two = _c(a), _c(b)
    every = F.forall(F.zip_with(F.split(one, ""), F.split(two, ""), lambda x, y: is_match(x, y, letters)), lambda m: m)
    return F.when(F.length(one) == F.length(two), (F.length(one) == 0) | every)


def n_count(seq: ColumnOrName) -> Column:
    return F.length(_c(seq)) - F.length(F.translate(_c(seq), "Nn", ""))


def n_fraction(seq: ColumnOrName) -> Column:
    """Share of N, 0 for an empty sequence."""
    size = F.length(_c(seq))
    return F.when(size > 0, (n_count(seq) / size).cast("float")).otherwise(F.lit(0.0).cast("float"))


def n_endpoint(text: ColumnOrName, end: ColumnOrName, m: int, k: int, most: float) -> Column:
    """Whether the characters that every alignment ending at ``end`` covers have few enough N."""
    stop = F.least(_c(end), F.length(_c(text)))
    size = F.least(F.lit(max(m - k, 0)), stop)
    part = _c(text).substr(stop - size + 1, size)
    return (n_count(part) / F.lit(m + k)).cast("float") <= F.lit(most).cast("float")


def match_region(text: ColumnOrName, start: ColumnOrName = "text_start", end: ColumnOrName = "text_end", strand: ColumnOrName = "strand", letters: str = "iupac", sam: bool = False) -> Column:
    """The matched part of an ASCII text, reverse complemented on the strand ``-`` unless in SAM style."""
    part = _c(text).substr(_c(start) + 1, _c(end) - _c(start))
    return part if sam else F.when(_c(strand) == "-", reverse_complement(part, letters)).otherwise(part)


def reverse_cigar(cigar: ColumnOrName) -> Column:
    return F.array_join(F.reverse(F.regexp_extract_all(_c(cigar), F.lit("([0-9]+[=XID])"))), "")


def format_cigar(cigar: ColumnOrName = "cigar", strand: ColumnOrName = "strand", sam: bool = False) -> Column:
    """The CIGAR in pattern direction, or in text direction in SAM style."""
    return F.when(_c(strand) == "-", reverse_cigar(cigar)).otherwise(_c(cigar)) if sam else _c(cigar)


def cigar_ops(cigar: ColumnOrName) -> Column:
    """array<struct<op, cnt>> of a CIGAR."""
    runs = F.regexp_extract_all(_c(cigar), F.lit("([0-9]+[=XID])"))
    return F.transform(runs, lambda r: F.struct(F.right(r, F.lit(1)).alias("op"), F.regexp_extract(r, "[0-9]+", 0).cast("int").alias("cnt")))


def alignment_path(cigar: ColumnOrName = "cigar", start: ColumnOrName = "text_start", end: ColumnOrName = "text_end", pattern_start: ColumnOrName = "pattern_start", strand: ColumnOrName = "strand") -> Column:
    """array<struct<pattern_pos, text_pos>>: where each operation begins.

    On the strand ``-`` text positions fall from the last matched character.
    """
    forward = _c(strand) == "+"
    step = F.when(forward, 1).otherwise(-1)
    first = F.struct(_c(pattern_start).cast("int").alias("pattern_pos"), F.when(forward, _c(start)).otherwise(_c(end) - 1).cast("int").alias("text_pos"))
    runs = F.transform(cigar_ops(cigar), lambda r: F.array_repeat(r["op"], r["cnt"]))

    def go(state: Column, op: Column) -> Column:
        at = state["at"]
        return F.struct(
            F.struct((at["pattern_pos"] + F.when(op == "D", 0).otherwise(1)).cast("int").alias("pattern_pos"), (at["text_pos"] + F.when(op == "I", 0).otherwise(step)).cast("int").alias("text_pos")).alias("at"),
            F.concat(state["path"], F.array(at)).alias("path"),
        )

    empty = F.array().cast("array<struct<pattern_pos:int,text_pos:int>>")
    return F.aggregate(F.flatten(runs), F.struct(first.alias("at"), empty.alias("path")), go, lambda s: s["path"])


def net_insertions(cigar: ColumnOrName) -> Column:
    """Insertions less deletions after the last match of a CIGAR."""
    tail = F.regexp_extract(_c(cigar), "((?:[0-9]+[XID])*)$", 1)
    return F.aggregate(cigar_ops(tail), F.lit(0), lambda n, r: n + F.when(r["op"] == "I", r["cnt"]).when(r["op"] == "D", -r["cnt"]).otherwise(0))


def overhang_steps(m: ColumnOrName, k: ColumnOrName, alpha: float, max_overhang: int | None = None) -> Column:
    """Positions beyond a text's end at which a pattern may end; single precision as in the kernel."""
    a = F.lit(float(np.float32(alpha))).cast("float")
    steps = _c(m).cast("int") if alpha == 0 else F.least(_c(m).cast("int"), F.ceil(((_c(k).cast("float") + a) / a).cast("float")).cast("int"))
    return steps if max_overhang is None else F.least(steps, F.lit(max_overhang))


def overshoot_cost(cost: ColumnOrName, end: ColumnOrName, size: ColumnOrName, alpha: float) -> Column:
    """The cost of an end with that of the part beyond a text of ``size`` characters."""
    beyond = F.greatest(_c(end) - _c(size), F.lit(0)).cast("float")
    return _c(cost) + F.floor((F.lit(alpha).cast("float") * beyond).cast("float")).cast("int")


def pam_pattern(pam: str) -> str:
    """A regular expression for the letters that a PAM matches."""
    table = alphabet("iupac").table
    known = [c for c in map(chr, range(33, 127)) if c.isalpha()]
    return "".join("[" + "".join(c for c in known if table[ord(p), ord(c)]) + "]" for p in pam)


def pam_match(text: ColumnOrName, end: ColumnOrName, pam: str) -> Column:
    """Whether the letters before ``end`` match the PAM; false where there are too few."""
    part = _c(text).substr(_c(end) - len(pam) + 1, F.lit(len(pam)))
    return (_c(end) >= len(pam)) & part.rlike(f"^{pam_pattern(pam)}$")


def strand_number(strand: ColumnOrName = "strand") -> Column:
    """0 for forward, 1 for the reverse complement."""
    return F.when(_c(strand) == "+", 0).otherwise(1)


def match_text(*columns: str) -> Column:
    """A match as JSON."""
    return F.to_json(F.struct(*(columns or ("text_start", "text_end", "pattern_start", "pattern_end", "cost", "strand", "cigar"))))


def fractional_k(pattern: ColumnOrName, share: float) -> Column:
    return F.lit(int(share)) if share >= 1 else F.ceil(F.length(_c(pattern)) * F.lit(share)).cast("int")


def prefix_value(plus: ColumnOrName, minus: ColumnOrName, j: int) -> Column:
    """Sum of the first ``j`` of 64 differences given as bits of +1 and -1."""
    mask = F.lit((1 << j) - 1 if j < 63 else -1 if j == 64 else (1 << 63) - 1).cast("long")
    return F.bit_count(_c(plus).bitwiseAND(mask)) - F.bit_count(_c(minus).bitwiseAND(mask))
