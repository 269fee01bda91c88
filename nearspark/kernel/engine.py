"""A search of all patterns in the texts of one Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from nearspark.kernel import scan
from nearspark.kernel.trace import alignments, trace
from nearspark.plans.options import SearchOptions

#: Bytes of text that are searched at once (one text at least).
SLICE_BYTES = 4 << 20
FIELDS = ("row", "pattern_idx", "text_start", "text_end", "pattern_start", "pattern_end", "cost", "strand", "cigar")
_N = np.zeros(256, bool)
_N[[78, 110]] = True


def as_texts(values: pa.Array) -> scan.Texts:
    """Bytes of a string or binary array; null is empty."""
    values = values.cast(pa.large_binary())
    buffers, n = values.buffers(), len(values)
    offsets = np.frombuffer(buffers[1], np.int64)[values.offset : values.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return scan.Texts(data, offsets - offsets[0])


def slices(values: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    sizes = pc.fill_null(pc.binary_length(values), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


class Engine:
    """Patterns prepared for repeated use; those of one length are scanned together."""

    def __init__(self, patterns: Sequence[bytes], options: SearchOptions):
        for p in patterns:
            options.check_pattern(p)
        self.patterns, self.options = list(patterns), options
        by_length: dict[int, list[int]] = {}
        for i, p in enumerate(patterns):
            by_length.setdefault(len(p), []).append(i)
        self.groups = [(np.array(ids), np.stack([np.frombuffer(patterns[i], np.uint8) for i in ids])) for _, ids in sorted(by_length.items())]

    def search(self, values: pa.Array) -> Iterator[dict[str, np.ndarray]]:
        """Matches of a string or binary array, in parts; ``row`` is the place in the array."""
        for a, b in slices(values):
            texts = as_texts(pc.fill_null(values.slice(a, b - a), "" if pa.types.is_string(values.type) else b""))
            if self.options.validate:
                self._validate(texts)
            for found in self._both_strands(texts):
                found["row"] = found["row"] + a
                yield found

    def _validate(self, texts: scan.Texts) -> None:
        letters = self.options.letters.letters
        if letters is not None:
            known = np.isin(np.arange(256), np.frombuffer((letters + letters.lower()).encode(), np.uint8))
            if not known[texts.data].all():
                raise ValueError(f"a text has letters that are not of the alphabet {self.options.alphabet}")

    def _both_strands(self, texts: scan.Texts) -> Iterator[dict[str, np.ndarray]]:
        letters = self.options.letters
        for ids, rows in self.groups:
            yield from self._strand(texts, ids, rows, "+")
        if not self.options.rc:
            return
        flipped = texts.reversed() if self.options.rc_mode == "text" else texts
        for ids, rows in self.groups:
            other = letters.complements[rows]
            if self.options.rc_mode == "text":
                for found in self._strand(flipped, ids, other, "-"):
                    n = texts.lengths[found["row"]]
                    start, end = found["text_start"], found["text_end"]
                    found["text_start"], found["text_end"] = n - end, np.where(start >= 0, n - start, -1)
                    yield found
            else:
                yield from self._strand(flipped, ids, other[:, ::-1], "-")

    def _ends(self, texts: scan.Texts, ids: np.ndarray, rows: np.ndarray, strand: str) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Chosen ends: (pattern number in ``ids``, texts, ends, costs)."""
        options = self.options
        m = rows.shape[1]
        for first, cost, begins in scan.costs(texts, rows, options):
            for p in range(len(cost)):
                at = scan.select(cost[p], begins, options.k, options.mode != "minima")
                text = np.searchsorted(begins, at, "right") - 1
                some = texts.lengths[text] > 0
                at, text = at[some], text[some]
                ends, price = at - begins[text], cost[p, at].astype(np.int64)
                keep = np.ones(len(at), bool)
                if options.pam is not None:
                    keep &= self._pam(texts, text, ends, strand)
                if options.max_n_frac is not None and options.max_n_frac < 1 and options.mode != "alignments" and (options.rc_mode == "text" or not options.trace):
                    keep &= self._n_before(texts, text, ends, m)
                text, ends, price = text[keep], ends[keep], price[keep]
                if options.best_only and len(text):
                    order = np.lexsort((-ends, price, text))
                    text, ends, price = text[order], ends[order], price[order]
                    lead = np.ones(len(text), bool)
                    lead[1:] = text[1:] != text[:-1]
                    text, ends, price = text[lead], ends[lead], price[lead]
                yield first + p, text, ends, price

    def _pam(self, texts: scan.Texts, text: np.ndarray, ends: np.ndarray, strand: str) -> np.ndarray:
        letters = self.options.letters
        pam = np.frombuffer(self.options.pam, np.uint8)
        if strand == "-":
            pam = letters.complements[pam] if self.options.rc_mode == "text" else letters.complements[pam][::-1]
        # the pattern's last characters lie first when its reverse complement is searched
        first = ends - len(pam)
        good = (first >= 0) & (ends <= texts.lengths[text])
        place = texts.offsets[text] + np.where(good, first, 0)
        for x, c in enumerate(pam):
            good &= letters.table[c][texts.data[np.minimum(place + x, len(texts.data) - 1)]]
        return good

    def _n_before(self, texts: scan.Texts, text: np.ndarray, ends: np.ndarray, m: int) -> np.ndarray:
        """Whether the text that any alignment to these ends must cover has few enough N."""
        k = self.options.k
        end = np.minimum(ends, texts.lengths[text])
        start = np.maximum(end - max(m - k, 0), 0)
        return self._n_share(texts, text, start, end, np.full(len(text), m + k)) | (start >= texts.lengths[text])

    def _n_share(self, texts: scan.Texts, text: np.ndarray, start: np.ndarray, end: np.ndarray, size: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(_N[texts.data])])
        count = sums[texts.offsets[text] + end] - sums[texts.offsets[text] + start]
        share = count.astype(np.float32) / np.maximum(size, 1).astype(np.float32)
        return (share <= np.float32(self.options.max_n_frac)) | (end == start)

    def _strand(self, texts: scan.Texts, ids: np.ndarray, rows: np.ndarray, strand: str) -> Iterator[dict[str, np.ndarray]]:
        options = self.options
        m = rows.shape[1]
        limited = options.max_n_frac is not None and options.max_n_frac < 1
        for p, text, ends, price in self._ends(texts, ids, rows, strand):
            if not len(text):
                continue
            start, length = texts.offsets[text], texts.lengths[text]
            if options.mode == "alignments":
                found = self._alignments(rows[p], texts, start, length, ends)
                text = text[found.pop("hit")]
            elif options.trace:
                columns = trace(rows[p], texts.data, start, length, ends, options)
                found = dict(zip(("text_start", "text_end", "pattern_start", "pattern_end", "cost", "cigar"), columns, strict=True))
            else:
                none = np.full(len(text), -1)
                beyond = np.maximum(ends - length, 0)
                found = {"text_start": none, "text_end": ends - beyond, "pattern_start": none, "pattern_end": m - beyond, "cost": price, "cigar": np.full(len(text), None, object)}
            if limited and (options.trace or options.mode == "alignments"):
                keep = self._n_share(texts, text, found["text_start"], found["text_end"], found["text_end"] - found["text_start"]) | (found["text_start"] >= texts.lengths[text])
                found, text = {c: v[keep] for c, v in found.items()}, text[keep]
            found |= {"row": text, "pattern_idx": np.full(len(text), ids[p]), "strand": np.full(len(text), strand, object)}
            yield found

    def _alignments(self, pattern: np.ndarray, texts: scan.Texts, start: np.ndarray, length: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
        hit, text_start, pattern_start, cost, cigar = alignments(pattern, texts.data, start, length, ends, self.options)
        return {"hit": hit, "text_start": text_start, "text_end": ends[hit], "pattern_start": pattern_start, "pattern_end": np.full(len(hit), len(pattern)), "cost": cost, "cigar": cigar}

    def ranges(self, values: pa.Array) -> Iterator[dict[str, np.ndarray]]:
        """Maximal runs of ends within ``k``: row, pattern_idx, strand, first_end, last_end, least cost."""
        for a, b in slices(values):
            texts = as_texts(pc.fill_null(values.slice(a, b - a), "" if pa.types.is_string(values.type) else b""))
            passes = [("+", [(ids, rows) for ids, rows in self.groups])]
            if self.options.rc:
                passes.append(("-", [(ids, self.options.letters.complements[rows][:, ::-1]) for ids, rows in self.groups]))
            for strand, groups in passes:
                for ids, rows in groups:
                    for first, cost, begins in scan.costs(texts, rows, self.options):
                        for p in range(len(cost)):
                            low, high = scan.islands(cost[p], begins, self.options.k)
                            text = np.searchsorted(begins, low, "right") - 1
                            least = np.array([cost[p, x : y + 1].min() for x, y in zip(low, high, strict=True)], np.int64)
                            yield {"row": text + a, "pattern_idx": np.full(len(low), ids[first + p]), "strand": np.full(len(low), strand, object), "first_end": low - begins[text], "last_end": high - begins[text], "cost": least}


def find(pattern: bytes, text: bytes, options: SearchOptions) -> list[tuple]:
    """Matches of one pattern in one text, forward ones first: FIELDS without row."""
    out = []
    for found in Engine([pattern], options).search(pa.array([text], pa.binary())):
        out += list(zip(*[found[c].tolist() for c in FIELDS[1:]], strict=True))
    return out
