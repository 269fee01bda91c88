"""Off-target search of guides that end in a PAM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from nearspark.operators.search import search
from nearspark.plans.options import SearchOptions


def check_guides(guides: Sequence[str | bytes], pam_length: int = 3) -> bytes:
    """The PAM that all guides end in; an error if they do not, or there are none."""
    plain = [g.encode() if isinstance(g, str) else g for g in guides]
    if not plain:
        raise ValueError("there are no guides")
    if pam_length < 0 or any(len(g) < pam_length for g in plain):
        raise ValueError("a guide is shorter than the PAM")
    pam = plain[0][len(plain[0]) - pam_length :]
    for g in plain:
        if g[len(g) - pam_length :] != pam:
            raise ValueError(f"the guide {g.decode()} does not end in the PAM {pam.decode()}")
    return pam


def crispr(texts: DataFrame, guides: Sequence[str | bytes], k: int, max_n_frac: float, pam_length: int = 3, allow_pam_edits: bool = False, rc: bool = True, text_col: str = "seq", keep: Sequence[str] | None = None) -> DataFrame:
    """Every end within ``k`` edits of a guide, the PAM unedited unless that is allowed.

    The columns of a match, and guide: the guide's sequence.
    """
    pam = check_guides(guides, pam_length)
    options = SearchOptions(alphabet="iupac", k=k, rc=rc, mode="all", max_n_frac=max_n_frac, pam=None if allow_pam_edits or not pam else pam)
    plain = [g if isinstance(g, str) else g.decode() for g in guides]
    found = search(texts, [(g, g) for g in plain], options, text_col=text_col, keep=keep)
    return found.withColumn("guide", F.col("pattern_id"))
