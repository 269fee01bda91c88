"""Functions that SQL can call once ``register`` has run on a session."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udf

from nearspark.functions.alphabets import alphabet, both_cases
from nearspark.kernel.engine import FIELDS, Engine
from nearspark.plans.options import SearchOptions

MATCHES = "array<struct<text_start:int,text_end:int,pattern_start:int,pattern_end:int,cost:int,strand:string,cigar:string>>"
_NAMES = FIELDS[2:]


def _search(mode: str, best: bool):
    def run(texts: pa.Array, patterns: pa.Array, ks: pa.Array, alphabets: pa.Array) -> pa.Array:
        out: list = [None] * len(texts)
        groups: dict[tuple, list[int]] = {}
        for i, key in enumerate(zip(patterns.to_pylist(), ks.to_pylist(), alphabets.to_pylist(), strict=True)):
            if None not in key and texts[i].is_valid:
                out[i] = []
                groups.setdefault(key, []).append(i)
        for (pattern, k, name), rows in groups.items():
            options = SearchOptions(alphabet=name, k=k, rc=alphabet(name).pairs is not None, mode=mode, best_only=best)
            for found in Engine([pattern.encode()], options).search(texts.take(pa.array(rows))):
                for row, *values in zip(found["row"].tolist(), *[found[c].tolist() for c in _NAMES], strict=True):
                    out[rows[row]].append(dict(zip(_NAMES, values, strict=True)))
        fields = [(c, pa.int32()) for c in _NAMES[:5]] + [(c, pa.string()) for c in _NAMES[5:]]
        return pa.array(out, pa.list_(pa.struct(fields)))

    # the registration looks at types, not at their names
    run.__annotations__ = dict.fromkeys(("texts", "patterns", "ks", "alphabets", "return"), pa.Array)
    return run


def register(spark: SparkSession) -> None:
    """fuzzy_search, fuzzy_search_all and fuzzy_best (text, pattern, k, alphabet), and functions on sequences.

    The first three give an array of matches, to be used with LATERAL VIEW
    inline(...); with the alphabets dna and iupac they search both strands.  A
    null argument gives null.
    """
    for name, mode, best in (("fuzzy_search", "minima", False), ("fuzzy_search_all", "all", False), ("fuzzy_best", "minima", True)):
        spark.udf.register(name, arrow_udf(_search(mode, best), MATCHES))
    a, b = both_cases(alphabet("iupac").pairs)
    letters = alphabet("iupac").letters
    made = {
        "complement(s STRING) RETURNS STRING": f"translate(s, '{a}', '{b}')",
        "revcomp(s STRING) RETURNS STRING": f"reverse(translate(s, '{a}', '{b}'))",
        "valid_seq(s STRING) RETURNS BOOLEAN": f"s RLIKE '^[{letters}{letters.lower()}]*$'",
        "n_frac(s STRING) RETURNS DOUBLE": "CASE WHEN length(s) > 0 THEN (length(s) - length(translate(s, 'Nn', ''))) / length(s) ELSE 0 END",
        "cigar_reverse(c STRING) RETURNS STRING": "array_join(reverse(regexp_extract_all(c, '([0-9]+[=XID])')), '')",
    }
    for head, body in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
