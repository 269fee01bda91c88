"""The kernel against fixed cases and plain dynamic programming."""

import random

import numpy as np
import pytest

from nearspark import SearchOptions
from nearspark.functions.alphabets import alphabet
from nearspark.kernel import trace
from nearspark.kernel.engine import find
from nearspark.kernel.trace import net_insertions
from nearspark.local import Searcher, at_end, edit_distance, mutate, path, plant, random_sequence


def run(pattern, text, **options):
    """(strand, text_start, text_end, pattern_start, pattern_end, cost, CIGAR)"""
    return [(r[6], *r[1:6], r[7]) for r in find(pattern.encode(), text.encode(), SearchOptions(**options))]


G20 = [("+", 4, 12, 0, 8, 0, "8="), ("-", 6, 14, 0, 8, 1, "1=1X6="), ("-", 2, 10, 0, 8, 1, "7=1X")]


@pytest.mark.parametrize(
    "pattern, text, options, expected",
    [
        ("ATCG", "CCCATCACCC", dict(alphabet="dna", k=1), [("+", 3, 7, 0, 4, 1, "3=1X")]),
        ("ATCG", "CCCATCACCC", dict(alphabet="dna", k=1, rc=True), [("+", 3, 7, 0, 4, 1, "3=1X"), ("-", 1, 5, 0, 4, 1, "2=1X1=")]),
        ("ACGT", "GTXXXNNN", dict(alphabet="iupac", k=1, alpha=0.5), [("+", 0, 2, 2, 4, 1, "2="), ("+", 5, 8, 0, 3, 0, "3=")]),
        ("ATCG", "AAAATTGAAA", dict(alphabet="iupac", k=1), [("+", 3, 7, 0, 4, 1, "2=1X1=")]),
        ("ABC", "XXXABCXXX", dict(k=1), [("+", 3, 6, 0, 3, 0, "3=")]),
        ("ATGC", "GGGGATTGCGGG", dict(alphabet="dna", k=1), [("+", 5, 9, 0, 4, 1, "1X3=")]),
        ("hello", "heeloo world", dict(k=1), [("+", 0, 5, 0, 5, 1, "2=1X2=")]),
        ("ATCGATCG", "GGGGATCGATCGTTTT", dict(alphabet="dna", k=1, rc=True), G20),
        ("ATG", "NTG", dict(alphabet="iupac", k=0), [("+", 0, 3, 0, 3, 0, "3=")]),
        ("ATG", "NTG", dict(alphabet="dna", k=0), []),
        ("abc", "", dict(k=3), []),
        ("HeLLo", "say hEllO", dict(alphabet="ascii_ci", k=0), [("+", 4, 9, 0, 5, 0, "5=")]),
    ],
)
def test_fixed_cases(pattern, text, options, expected):
    assert run(pattern, text, **options) == expected


def test_every_end():
    assert [(m[2], m[5]) for m in run("ABC", "XXXABCXXX", k=1, mode="all")] == [(5, 1), (6, 0), (7, 1)]


def test_overhang():
    found = run("GGGGAAAA", "TTTTTTTTTTTTTTTTGGGG", alphabet="iupac", k=4, alpha=0.5)
    assert len(found) == 2 and any(m[2] == 20 and m[4] == 3 and m[5] == 2 for m in found)
    assert any(m[2] == 1 and m[5] == 1 for m in run("ATC", "CGGGGGG", alphabet="iupac", k=3, alpha=0.5))
    assert path(Searcher("iupac", rc=False, alpha=0.5).search("ATCGATCG", "ATCGGGGGGGGGG", 2)[0])[:4] == [(4, 0), (5, 1), (6, 2), (7, 3)]
    assert len(run("AAAA", "GGGGGG", alphabet="iupac", k=2, alpha=0.5, max_n_frac=0.0, mode="all")) == 4


def test_share_of_n():
    text = "NNNNNNNNNNNNNAAAAAAAAAAAAAAAAAANNNNNNNGTACGT"
    ends = lambda **o: [m[2] for m in run("ACGTACGTACGT", text, alphabet="iupac", k=1, mode="all", **o)]
    assert ends() == [11, 12, 13, 14, 43, 44]
    assert ends(max_n_frac=0.5) == [44]


@pytest.mark.parametrize(
    "pattern, text, k, groups, total",
    [("ACGT", "ACGT", 0, 1, 1), ("ACGT", "TTTT", 2, 0, 0), ("AA", "AAAA", 0, 3, 3), ("AAAAAAAA", "AAAAA", 3, 1, 56), ("AAAA", "AAAAAA", 2, 3, 3)],
)
def test_alignments(pattern, text, k, groups, total):
    found = Searcher("dna", rc=False).search_all_alignments(pattern, text, k)
    assert (len(found), sum(map(len, found))) == (groups, total)


def test_alignment_details():
    found = Searcher("dna", rc=False).search_all_alignments("AT", "ACT", 1)
    several = [g for g in found if len(g) > 1]
    assert len(several) == 1 and {m.cigar for m in several[0]} == {"1X1=", "1=1D1=", "1I1="}
    for rc in (False, True):
        for group in Searcher("dna", rc=rc).search_all_alignments("ACGT", "XACGTX", 1):
            assert all(m.cigar[1] != "D" and m.cigar[-1] != "D" for m in group)
    n = lambda p: sum(map(len, Searcher("iupac", rc=False).search_all_alignments(p, "AAAAAAA", 2)))
    assert n("NAAA") == n("AAAA") == 4
    limited = lambda f: len(Searcher("iupac", rc=False, max_n_frac=f).search_all_alignments("ACGTACGTACGT", "ACGTACNNNNNN", 0))
    assert (limited(0.49), limited(0.5)) == (0, 1)
    first = find(b"AAAAAAAA", b"AAAAA", SearchOptions(alphabet="dna", k=3, mode="alignments", max_per_end=1))
    assert len(first) == 1


def test_alignments_pruned_by_a_predicate():
    every = dict(alphabet="dna", k=2, mode="alignments", partial=True)
    found = run("ACGTAC", "TTACGTTACGG", **every)
    kept = run("ACGTAC", "TTACGTTACGG", **every, prune=lambda start, p, cost: (cost > 0) & (p > 2))
    # what grew out of a pruned one is gone, the pruned ones themselves are not
    assert 0 < len(kept) < len(found) and set(kept) < set(found)
    assert run("ACGTAC", "TTACGTTACGG", **every, prune=lambda start, p, cost: np.zeros(len(p), bool)) == found
    assert all(p == 6 for _, _, _, p, *_ in run("ACGTAC", "TTACGTTACGG", **every, prune=lambda start, p, cost: p > 0))


def test_alignments_of_many_ends_are_those_of_each():
    rng = random.Random(5)
    for _ in range(20):
        p, t = random_sequence(rng, rng.randint(2, 7)), random_sequence(rng, 60)
        options = SearchOptions(alphabet="dna", k=rng.randint(0, 2), mode="alignments", partial=rng.random() < 0.5, max_per_end=rng.choice([None, 1, 3]))
        pattern, data = np.frombuffer(p, np.uint8), np.frombuffer(t, np.uint8)
        ends = np.arange(61)
        many = trace.alignments(pattern, data, np.zeros(61, np.int64), np.full(61, 60), ends, options)
        each = [trace.alignments(pattern, data, np.zeros(1, np.int64), np.full(1, 60), ends[e : e + 1], options) for e in range(61)]
        for x in range(1, 5):
            assert many[x].tolist() == [v for one in each for v in one[x].tolist()]


def test_net_insertions():
    assert net_insertions(list("=I")) == 1 and net_insertions(list("IXD")) == 0 and net_insertions(list("I=")) == 0 and net_insertions([]) == 0


def plain_costs(p, t):
    row, out = list(range(len(p) + 1)), [len(p)]
    for c in t:
        new = [0]
        for j in range(1, len(p) + 1):
            new.append(min(row[j - 1] + (p[j - 1] != c), row[j] + 1, new[-1] + 1))
        row = new
        out.append(row[-1])
    return out


def minima(cost, k):
    falling, out = True, []
    for i in range(1, len(cost)):
        if falling and cost[i] > cost[i - 1] <= k:
            out.append((i - 1, cost[i - 1]))
        falling = cost[i] < cost[i - 1] or (falling and cost[i] == cost[i - 1])
    return out + [(len(cost) - 1, cost[-1])] * (falling and cost[-1] <= k)


def test_costs_against_plain_programming():
    rng = random.Random(1)
    for _ in range(150):
        m, n = rng.choice([1, 3, 8, 20, 63, 64, 65, 100, 130]), rng.choice([1, 5, 50, 600, 1500])
        k = rng.randint(0, max(1, m // 4))
        p, t = ("".join(rng.choice("ab") for _ in range(x)) for x in (m, n))
        cost = plain_costs(p, t)
        assert [(x[2], x[5]) for x in run(p, t, k=k, mode="all")] == [(i, c) for i, c in enumerate(cost) if c <= k]
        assert [(x[2], x[5]) for x in run(p, t, k=k)] == minima(cost, k)


@pytest.mark.parametrize("letters", ["ascii", "ascii_ci", "dna", "iupac"])
def test_windows_near_pieces_hold_all_matches(monkeypatch, letters):
    from nearspark.kernel import scan

    rng = random.Random(9)
    for _ in range(40):
        p = random_sequence(rng, rng.randint(16, 90)).decode()
        t = plant(rng, random_sequence(rng, 3000), [mutate(rng, p.encode(), rng.randint(0, 4)) for _ in range(4)])[0].decode()
        if letters == "iupac":
            t = "".join(rng.choice("NRY") if rng.random() < 0.002 else c for c in t)
        if letters != "ascii":
            t = "".join(c.lower() if rng.random() < 0.3 else c for c in t)
        more = dict(alphabet=letters, k=rng.randint(0, 3), rc=letters in ("dna", "iupac"), mode=rng.choice(["minima", "all"]))
        if letters == "iupac":
            more |= dict(alpha=rng.choice([None, 0.4]))
        found = run(p, t, **more)
        with monkeypatch.context() as patch:
            patch.setattr(scan, "SHORTEST", 99)
            assert run(p, t, **more) == found


def test_alignments_are_what_they_say():
    rng = random.Random(2)
    for _ in range(60):
        p = random_sequence(rng, rng.randint(4, 40)).decode()
        t = plant(rng, random_sequence(rng, 200), [mutate(rng, p.encode(), 2)])[0].decode()
        for strand, start, end, _, _, cost, cigar in run(p, t, alphabet="dna", k=3, rc=True):
            piece = t[start:end]
            if strand == "-":
                piece = alphabet("dna").reverse_complement(piece.encode()).decode()
            assert edit_distance(p.encode(), piece.encode()) == cost <= 3
            ops = [(int("".join(c for c in part if c.isdigit())), part[-1]) for part in __import__("re").findall(r"[0-9]+[=XID]", cigar)]
            assert sum(n for n, op in ops if op != "=") == cost
            assert sum(n for n, op in ops if op in "=XI") == len(p) and sum(n for n, op in ops if op in "=XD") == len(piece)


def test_reverse_complement_is_forward_search_of_reversed_text():
    rng = random.Random(3)
    for _ in range(80):
        p = random_sequence(rng, rng.randint(4, 20))
        t = random_sequence(rng, len(p) + rng.randint(0, 10))
        k = rng.randint(0, 3)
        minus = [m for m in Searcher("dna").search(p, t, k) if m.strand == "-"]
        forward = Searcher("dna", rc=False).search(p, alphabet("dna").reverse_complement(t), k)
        assert [(len(t) - m.text_end, len(t) - m.text_start, m.cost, m.cigar) for m in minus] == [(m.text_start, m.text_end, m.cost, m.cigar) for m in forward]


def plain_overhang(p, t, k, alpha, most):
    a = np.float32(alpha)
    left = [int(np.floor(np.float32(min(j, most)) * a)) + max(0, j - most) for j in range(len(p) + 1)]
    row, out = left, [left[-1]]
    steps = min(len(p), int(np.ceil((np.float32(k) + a) / a)), most)
    for i, c in enumerate(t + "?" * steps, 1):
        new = [0]
        for j in range(1, len(p) + 1):
            new.append(min(row[j - 1] + (c != "?" and p[j - 1] != c), row[j] + 1, new[-1] + 1))
        row = new
        out.append(row[-1] + int(np.floor(a * np.float32(max(0, i - len(t))))))
    return out


def test_overhang_against_plain_programming():
    rng = random.Random(4)
    for _ in range(80):
        p, t = random_sequence(rng, rng.randint(2, 30)).decode(), random_sequence(rng, rng.randint(1, 700)).decode()
        k, alpha, most = rng.randint(0, 6), rng.choice([0.2, 0.5, 0.7, 1.0]), rng.choice([2, 5, 99])
        cost = plain_overhang(p, t, k, alpha, most)
        found = run(p, t, alphabet="iupac", k=k, alpha=alpha, max_overhang=most)
        assert [(min(i, len(t)), c) for i, c in minima(cost, k)] == [(m[2], m[5]) for m in found]


def test_searcher_and_errors():
    assert Searcher("ascii").options.rc is False
    many = Searcher("dna", rc=False).search_many(["ACG", "TTT"], ["ACGTTT", "GGG"], 0)
    assert [(m.pattern_idx, m.text_idx, m.text_start) for m in many] == [(0, 0, 0), (1, 0, 3)]
    assert many[0].without_cigar().cigar is None and sorted(many) == many
    assert at_end(b"AAAAAA", b"CC") == b"AAAACC"
    for bad in (dict(alphabet="x"), dict(k=-1), dict(rc=True), dict(alphabet="dna", alpha=0.5), dict(alphabet="iupac", alpha=2.0), dict(max_n_frac=3.0), dict(alphabet="iupac", alpha=0.5, mode="alignments")):
        with pytest.raises(ValueError):
            SearchOptions(**bad)
    with pytest.raises(ValueError):
        find(b"AXE!", b"ACGT", SearchOptions(alphabet="iupac"))
    with pytest.raises(ValueError):
        find(b"ACG", b"ACG-", SearchOptions(alphabet="dna", validate=True))
