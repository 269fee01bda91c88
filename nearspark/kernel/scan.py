"""Costs of all end positions, by bit-parallel steps over many windows at once.

Every text is cut into windows of ``WINDOW`` end positions, each preceded by
the ``m + k`` characters that an alignment within ``k`` edits can reach.  A
lane is one window with one pattern; a step advances all lanes by one
character.  Costs up to ``k`` are exact, larger ones are given as ``k + 1``.

Where a pattern's pieces say enough, only windows near an unchanged piece are
looked at: one of ``k + 1`` disjoint pieces is in every match that lies within
its text and has no letter that stands for several.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from nearspark.plans.options import SearchOptions, pieces

WINDOW = 512
#: Lanes that are advanced together, about: their state stays in the cache.
LANES = 1 << 14
#: The character that matches all others, after a text's end.
ANY = 256
_ONE = np.uint64(1)
#: Pieces shorter than this are everywhere.
SHORTEST = 4
#: Share of the text that windows near pieces may cover; beyond it all of it is scanned.
DENSE = 0.4


class Texts:
    """Concatenated texts; text ``t`` is ``data[offsets[t]:offsets[t + 1]]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.lengths = np.diff(offsets)

    def reversed(self) -> Texts:
        """The same texts in the same order, each reversed."""
        flipped = self.data[::-1]
        starts = self.offsets[-1] - self.offsets[1:]
        order = np.repeat(starts - self.offsets[:-1], self.lengths) + np.arange(len(self.data))
        return Texts(flipped[order], self.offsets)

    def padded(self, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """Characters with ``steps`` of ANY after each text, and where each text begins."""
        if steps == 0:
            return self.data, self.offsets[:-1]
        starts = self.offsets[:-1] + steps * np.arange(len(self.lengths))
        out = np.full(len(self.data) + steps * len(self.lengths), ANY, np.uint16)
        out[np.repeat(starts - self.offsets[:-1], self.lengths) + np.arange(len(self.data))] = self.data
        return out, starts


def masks(patterns: np.ndarray, options: SearchOptions) -> np.ndarray:
    """(words, patterns, 257): the pattern positions that each character matches."""
    p, m = patterns.shape
    words = -(-m // 64)
    out = np.zeros((words, p, 257), np.uint64)
    for j in range(m):
        hit = options.letters.table[patterns[:, j]].astype(np.uint64) << np.uint64(j % 64)
        out[j // 64, :, :256] |= hit
        out[j // 64, :, ANY] |= _ONE << np.uint64(j % 64)
    return out


def _occurrences(data: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """Places of a piece of ``SHORTEST`` bytes or more, in no order."""
    width = 8 if len(piece) >= 8 else 4
    kind = np.dtype(f"<u{width}")
    wanted = piece[:width].view(kind)[0]
    found = []
    for o in range(width):
        words = (len(data) - o) // width
        if words > 0:
            found.append(np.flatnonzero(data[o : o + words * width].view(kind) == wanted) * width + o)
    at = np.concatenate(found) if found else np.zeros(0, np.int64)
    at = at[at + len(piece) <= len(data)]
    for i in range(width, len(piece)):
        at = at[data[at + i] == piece[i]]
    return at


class _Plain:
    """Texts as representatives of equal letters, and the places of letters that stand for several."""

    def __init__(self, texts: Texts, options: SearchOptions):
        codes = options.letters.codes
        several = np.zeros(256, bool)
        if options.letters.name == "iupac":
            several[:] = [bin(c).count("1") != 1 for c in codes]
        self.codes, self.several = codes, several
        self.data = np.ascontiguousarray(codes[texts.data])
        self.unclear = np.flatnonzero(several[texts.data]) if several.any() else np.zeros(0, np.int64)


def _near_pieces(texts: Texts, plain: _Plain, pattern: np.ndarray, sizes: np.ndarray, begins: np.ndarray, options: SearchOptions) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Text, first and last of windows (ends from first + 1 to last) that hold all matches; None: too many."""
    m, k, warm = len(pattern), options.k, len(pattern) + options.k
    parts = pieces(pattern.tobytes(), k)
    if min(map(len, parts)) < SHORTEST or plain.several[pattern].any() or len(plain.unclear) * warm > DENSE * len(texts.data):
        return None
    low, high, text = [], [], []

    def add(places: np.ndarray, before: int, after: int, size: int = 1) -> None:
        t = np.searchsorted(texts.offsets, places, "right") - 1
        whole = places + size <= texts.offsets[t + 1]
        t, at = t[whole], (places - texts.offsets[t])[whole]
        text.append(t)
        low.append(at + before)
        high.append(at + after)

    offset, budget = 0, DENSE * len(texts.data)
    for part in parts:
        at = _occurrences(plain.data, plain.codes[np.frombuffer(part, np.uint8)])
        budget -= len(at) * (2 * k + 1)
        if budget < 0:
            return None
        add(at, m - offset - k - 1, m - offset + k, len(part))
        offset += len(part)
    add(plain.unclear, 0, warm)
    if options.alpha is not None:
        some = np.flatnonzero(texts.lengths > 0)
        text += [some, some]
        low += [np.zeros(len(some), np.int64), texts.lengths[some]]
        high += [np.full(len(some), warm), sizes[some]]
    text, low, high = np.concatenate(text), np.concatenate(low), np.concatenate(high)
    low, high = begins[text] + np.maximum(low, 0), begins[text] + np.minimum(high, sizes[text])
    keep = high > low
    order = np.argsort(low[keep], kind="stable")
    low, high = low[keep][order], high[keep][order]
    reach = np.maximum.accumulate(high)
    ends = np.ones(len(low), bool)
    ends[:-1] = low[1:] > reach[:-1]
    starts = np.ones(len(low), bool)
    starts[1:] = ends[:-1]
    low, high = low[starts], reach[ends]
    if (high - low).sum() + warm * len(low) > DENSE * 2 * len(texts.data):
        return None
    text = np.searchsorted(begins, low, "right") - 1
    return text, low - begins[text], high - begins[text]


def costs(texts: Texts, patterns: np.ndarray, options: SearchOptions) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For slices of the patterns (all of one length): the first one's number, costs and where each text's costs begin.

    ``costs[p, begin[t] + i]`` is for end ``i`` of text ``t``, ``i`` from 0 to
    its length plus the overhang steps.  Texts without characters have no
    costs: their entries are ``k + 1``.
    """
    p, m = patterns.shape
    k, steps = options.k, options.overhang_steps(m)
    padded = texts.padded(steps)
    sizes = np.where(texts.lengths > 0, texts.lengths + steps, 0)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])
    eq = masks(patterns, options)
    left = options.left_costs(m)
    plain = _Plain(texts, options) if m // (k + 1) >= SHORTEST else None
    everywhere = []
    for a in range(p):
        near = None if plain is None else _near_pieces(texts, plain, patterns[a], sizes, begins, options)
        if near is None:
            everywhere.append(a)
            continue
        out = _blank(1, texts, begins, left, m, k)
        _scan(padded, *near, begins, eq[:, a : a + 1], left, m, k, out)
        yield a, _with_ends(out, texts, begins, steps, k, options), begins
    if not everywhere:
        return
    none = np.zeros(len(sizes), np.int64)
    windows = np.arange(len(sizes)), none, sizes
    lanes = max(1, int((-(-sizes // WINDOW)).sum()))
    tile = max(1, LANES // lanes)
    runs = np.split(np.array(everywhere), np.flatnonzero(np.diff(everywhere) != 1) + 1)
    for run in runs:
        for a in range(0, len(run), tile):
            part = run[a : a + tile]
            out = _blank(len(part), texts, begins, left, m, k)
            _scan(padded, *windows, begins, eq[:, part], left, m, k, out)
            yield int(part[0]), _with_ends(out, texts, begins, steps, k, options), begins


def _blank(p: int, texts: Texts, begins: np.ndarray, left: np.ndarray, m: int, k: int) -> np.ndarray:
    out = np.full((p, begins[-1]), k + 1, np.int16 if m + k < 30000 else np.int32)
    out[:, begins[:-1][texts.lengths > 0]] = min(int(left[m]), k + 1)
    return out


def _with_ends(out: np.ndarray, texts: Texts, begins: np.ndarray, steps: int, k: int, options: SearchOptions) -> np.ndarray:
    """The costs of what lies beyond the texts' ends added."""
    if steps:
        beyond = options.right_costs(np.arange(1, steps + 1)).astype(out.dtype)
        some = np.flatnonzero(texts.lengths > 0)
        at = begins[some + 1][:, None] - steps + np.arange(steps)
        out[:, at] = np.minimum(out[:, at] + beyond, k + 1)
    return out


def _scan(padded, text, first, last, begins, eq, left, m, k, out) -> None:
    """Costs of the ends from ``first + 1`` to ``last`` of the given texts."""
    data, starts = padded
    counts = -(-(last - first) // WINDOW)
    n = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    text, stop = np.repeat(text, counts), np.repeat(last, counts)
    first = np.repeat(first, counts) + n * WINDOW
    last = np.minimum(first + WINDOW, stop)
    start = np.maximum(first - (m + k), 0)
    order = np.argsort(start - last, kind="stable")  # longest first: active lanes stay in front
    text, first, last, start = text[order], first[order], last[order], start[order]
    for w in range(0, len(text), LANES):
        x = slice(w, w + LANES)
        _advance(data, starts[text[x]] + start[x], last[x] - start[x], first[x] - start[x], start[x] == 0, begins[text[x]] + start[x], eq, left, m, k, out)


def _advance(data, at, lengths, lead, from_start, target, eq, left, m, k, out) -> None:
    words, p = eq.shape[:2]
    n = len(at)
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    step_up = np.diff(left) > 0  # vertical steps at a text's start
    up, down = [], []
    for word in range(words):
        bits = np.uint64(sum(1 << j for j, s in enumerate(step_up[64 * word : 64 * word + 64]) if s))
        up.append(np.tile(np.where(from_start, bits, ones), (p, 1)))
        down.append(np.zeros((p, n), np.uint64))
    score = np.tile(np.where(from_start, left[m], m), (p, 1)).astype(out.dtype)
    top = np.uint64((m - 1) % 64)
    flat = [np.ascontiguousarray(e).reshape(p, 257) for e in eq]
    ends = np.searchsorted(-lengths, -np.arange(int(lengths[0]) if n else 0), "left")  # lanes that have a character at step t
    longest_lead = int(lead.max(initial=0))
    limit = out.dtype.type(k + 1)
    for t in range(len(ends)):
        live = int(ends[t])
        if live < score.shape[1]:
            up, down = [v[:, :live].copy() for v in up], [v[:, :live].copy() for v in down]
            score = score[:, :live].copy()
        chars = data[at[:live] + t]
        plus = minus = None
        for word in range(words):
            e = flat[word][:, chars]
            pv, mv = up[word], down[word]
            xv = e | mv
            if minus is not None:
                e |= minus
            xh = e & pv
            xh += pv
            xh ^= pv
            xh |= e
            ph = xh | pv
            np.invert(ph, out=ph)
            ph |= mv
            mh = pv & xh
            if word == words - 1:
                score += ((ph >> top) & _ONE).astype(score.dtype)
                score -= ((mh >> top) & _ONE).astype(score.dtype)
                out_plus = out_minus = None
            else:
                out_plus, out_minus = ph >> np.uint64(63), mh >> np.uint64(63)
            ph <<= _ONE
            mh <<= _ONE
            if plus is not None:
                ph |= plus
                mh |= minus
            pv = xv | ph
            np.invert(pv, out=pv)
            pv |= mh
            up[word], down[word] = pv, ph & xv
            plus, minus = out_plus, out_minus
        where = target[:live] + (t + 1)
        if t < longest_lead:
            own = np.flatnonzero(lead[:live] <= t)
            out[:, where[own]] = np.minimum(score[:, own], limit)
        else:
            out[:, where] = np.minimum(score, limit)


def select(cost: np.ndarray, begins: np.ndarray, k: int, every: bool) -> np.ndarray:
    """Places of reported ends: all within ``k``, or the last ones of local minima.

    A minimum ends where the cost rises next, or the text ends, if the last
    change up to there was a fall, or there was none.
    """
    at = np.flatnonzero(cost <= k)
    if every or not len(at):
        return at
    text = np.searchsorted(begins, at, "right") - 1
    price = cost[at]
    final = at == begins[text + 1] - 1
    ends = final | (cost[np.minimum(at + 1, len(cost) - 1)] > price)
    begin = at == begins[text]
    new = np.ones(len(at), bool)  # whether a run of equal costs begins
    new[1:] = (at[1:] != at[:-1] + 1) | (price[1:] != price[:-1]) | begin[1:]
    lead = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    fell = begin[lead] | (cost[np.maximum(at[lead] - 1, 0)] > price)
    return at[ends & fell]


def islands(cost: np.ndarray, begins: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of maximal runs of ends within ``k``."""
    within = cost <= k
    before = np.zeros(len(cost), bool)
    before[1:] = within[:-1]
    before[begins[:-1]] = False
    after = np.zeros(len(cost), bool)
    after[:-1] = within[1:]
    after[begins[1:] - 1] = False
    return np.flatnonzero(within & ~before), np.flatnonzero(within & ~after)
