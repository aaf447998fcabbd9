"""Text primitives, staged tables and connected components."""

import random

import numpy as np
import pyarrow as pa
import pytest

from annolith.llm import cluster, line_dedup, textkit
from annolith.llm.chaining import Fenwick, align, chains, common, occurrences, picked_runs, seeds_at
from annolith.llm.line_dedup import edit_distance, rough_distance

from .helpers import Union, levenshtein


def test_words_and_hashes():
    texts = ["one two  three", "", "  ", "tail", None, "é è\tone", "x" * 50]
    raw, off = textkit.utf8(pa.array(texts))
    w, hasher = textkit.Words(raw, off, textkit.byte_table(False)), textkit.Hasher()
    h = hasher.spans(w.data, w.starts, w.ends)
    for i, t in enumerate(texts):
        mine = [bytes(w.data[a:b]) for a, b in zip(w.starts[w.first[i] : w.first[i + 1]], w.ends[w.first[i] : w.first[i + 1]], strict=True)]
        assert mine == (t or "").encode().split()
    assert h[0] == h[list(w.row).index(5) + 2] and len(set(h.tolist())) == len(h) - 1
    assert [r for r in textkit.runs(off, 10)][0] == (0, 1)


def test_majority_counts_every_bit():
    r = np.random.default_rng(1)
    h = r.integers(0, 2**63, 70_000, dtype=np.uint64)
    first = np.array([0, 0, 1, 3, 300, 1200, 70_000])
    for a, b, got in zip(first, first[1:], textkit.majority(h, first), strict=False):
        bits = textkit.bits(h[a:b]).sum(0, dtype=int)
        assert int(got) == sum(1 << i for i in range(64) if 2 * bits[i] > b - a)


def test_connected_components(spark):
    r = random.Random(3)
    edges = [(r.randint(0, 400), r.randint(0, 400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7)]
    u = Union({x for e in edges if e[0] != e[1] for x in e})
    for a, b in edges:
        if a != b:
            u.join(a, b)
    got = cluster.connected_components(spark.createDataFrame(edges, "u long, v long"))
    assert {(x.node, x.root) for x in got.collect()} == {(x, u.find(x)) for x in u.p}
    assert cluster.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_key_bitmap_misses_none(spark):
    keys = [0, 1, -1, 2**62, -(2**62), 12345678901]
    m = cluster.key_bitmap(spark.createDataFrame([(k,) for k in keys], "k long"), "k")
    assert cluster.in_bitmap(m, np.array(keys, np.int64).view(np.uint64)).all()
    assert not cluster.in_bitmap(m, np.array([99], np.uint64)).any() and len(m) == cluster.LEAST_BITS // 8


def test_stage_needs_a_shared_folder_and_can_be_dropped(spark):
    df = cluster.stage(spark.range(5).toDF("x"))
    assert df.count() == 5 and df._annolith_path.startswith(spark.conf.get("spark.checkpoint.dir"))
    cluster.drop(df)
    with pytest.raises(Exception):
        spark.read.parquet(df._annolith_path).count()


def test_sorted_runs_join_over_batches():
    b = [pa.RecordBatch.from_pydict({"k": [1, 1, 2]}), pa.RecordBatch.from_pydict({"k": [2, 2, 3]}), pa.RecordBatch.from_pydict({"k": [3]})]
    assert [(t.column("k")[0].as_py(), t.num_rows) for t in cluster.sorted_runs(b, ["k"])] == [(1, 2), (2, 3), (3, 2)]


def test_edit_distance():
    r = random.Random(5)
    for _ in range(400):
        a, b = ("".join(r.choices("abé", k=r.randint(0, 12))) for _ in range(2))
        assert edit_distance(a, b, 99) == levenshtein(a, b)
        d = levenshtein(a, b)
        assert (edit_distance(a, b, 3) <= 3) == (d <= 3)


def test_common_subsequence():
    r = random.Random(6)
    for _ in range(200):
        a, b = (np.array(r.choices(range(5), k=r.randint(0, 12)), np.uint32) for _ in range(2))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert common(a, b) == t[-1, -1]


def test_seeds_in_every_six_words():
    r = np.random.default_rng(2)
    h = r.integers(0, 2**62, 300, dtype=np.uint64)
    at = seeds_at(h, np.repeat([0, 1], 150))
    assert all(((at >= i) & (at < i + 3)).any() for i in [*range(144), *range(150, 294)])
    assert not ((at > 146) & (at < 150)).any()
    assert list(occurrences(np.array([5, 7, 5, 5, 7], np.uint64))) == [0, 0, 1, 2, 1]


def test_picked_long_runs():
    r = np.random.default_rng(3)
    keys = r.integers(0, 2**62, 90, dtype=np.uint64)
    begins = np.concatenate([np.arange(5, 55), np.arange(200, 203), np.arange(300, 337)])
    at = picked_runs(begins, keys)
    for lo, hi in ((0, 50), (50, 53), (53, 90)):
        mine = at[(at >= lo) & (at < hi)]
        want = {i + int(np.argmin(keys[i : min(i + 8, hi)])) for i in range(lo, hi)} | {lo + int(np.argmin(keys[lo : lo + i])) for i in range(1, 8) if lo + i <= hi}
        assert set(mine.tolist()) == want
    assert len(picked_runs(begins[:0], keys[:0])) == 0


def test_whole_runs_cut_no_run():
    b = [pa.RecordBatch.from_pydict({"k": k}) for k in ([1, 1, 2], [2], [2, 2], [3, 3], [4, 5])]
    got = [t.column("k").to_pylist() for t in cluster.whole_runs(b, ["k"])]
    assert sum(got, []) == [1, 1, 2, 2, 2, 2, 3, 3, 4, 5] and all(set(x).isdisjoint(y) for x, y in zip(got, got[1:], strict=False))


def test_rough_distance_is_an_upper_bound():
    r = random.Random(3)
    for _ in range(300):
        w = ["".join(r.choice("abc") for _ in range(r.randint(1, 4))) for _ in range(r.randint(1, 14))]
        v = list(w)
        for _ in range(r.randint(0, 5)):
            v[r.randint(0, len(v)) :][:1] = ["zz"]
            v.insert(r.randint(0, len(v)), "q" * r.randint(1, 3))
            if len(v) > 1:
                del v[r.randrange(len(v))]
        a, b = " ".join(w), " ".join(v)
        assert rough_distance(a, b, 10**9) >= levenshtein(a, b) and rough_distance(a, a, 0) == 0


def test_fenwick_and_chains():
    f, r, best = Fenwick(50), random.Random(4), {}
    for k in range(200):
        i, v = r.randint(1, 50), r.random()
        f.put(i, (v, k))
        best[i] = max(best.get(i, (-1e18, -1)), (v, k))
        at = r.randint(0, 50)
        assert f.top(at) == max([x for j, x in best.items() if j <= at], default=(-1e18, -1))
    pos, rpos = np.array([0, 5, 10, 15, 20, 25]), np.array([100, 105, 3, 115, 120, 700])
    assert [list(c) for c in chains(pos, rpos)] == [[0, 1, 3, 4]]
    q = np.arange(100, dtype=np.uint32)
    t = q.copy()
    t[40] = 999
    assert align(q, t, np.array([10, 50]), np.array([10, 50])) == (0, 100, 0, 100, 0.99)


def test_distances_side_by_side():
    """Pairs compared side by side agree with the plain table, at every length of the blocks and with rare letters."""
    rng = random.Random(7)

    for size in (1, 20, 63, 64, 65, 128, 190):
        pairs = []
        for _ in range(40):
            a = "".join(rng.choice("abcde é漢") for _ in range(max(1, size + rng.randint(-3, 3))))
            b = list(a)
            for _ in range(rng.randint(0, len(a) * 2 // 5 + 1)):
                at = rng.randrange(len(b) + 1)
                b[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "a"])
            b = "".join(b) or "y"
            pairs.append((a, b, line_dedup.most_edits(a, b, 0.8)))
        assert len(pairs) >= line_dedup.FEW
        assert line_dedup.within_edits(pairs) == [levenshtein(a, b) <= most for a, b, most in pairs]
    assert line_dedup.within_edits([]) == []


def test_letters_bound_the_distance_from_below():
    import pyarrow as pa

    r = random.Random(8)
    texts = ["", "a", "é漢 a"] + ["".join(r.choice(k) for _ in range(r.randint(1, 40))) for k in ("abc ", "xyzé", "漢字語 a", "аб вг", "😀a1٣") for _ in range(12)]
    letters = line_dedup.letters_of(pa.chunked_array([texts[:9], texts[9:]]), np.arange(len(texts)))
    assert letters.sum(1).tolist() == [len(t) for t in texts]
    a, b = (x.ravel() for x in np.indices((len(texts), len(texts))))
    got = line_dedup.apart_at_least(letters, a, b).tolist()
    assert all(x <= levenshtein(texts[i], texts[j]) for x, i, j in zip(got, a.tolist(), b.tolist(), strict=True))
    i, j = texts.index("a"), texts.index("é漢 a")
    assert got[i * len(texts) + j] == 3


def test_pairs_of_other_letters_are_not_compared(monkeypatch):
    """Of lines that meet in a bucket with near fingerprints, those whose letters alone differ too much."""
    import pyarrow as pa

    r = random.Random(9)
    one = [" ".join("".join(r.choice(k) for _ in range(6)) for _ in range(20)) for k in ("abcdef", "ghijkl", "mnopqr", "stuvwx") for _ in range(6)]
    texts = sorted(one + [t[:-3] + "zzz" for t in one[::6]])
    marks = line_dedup.packed(np.tile(np.arange(line_dedup.TABLES, dtype=np.uint32), (len(texts), 1)))
    rows = pa.table({"bucket": pa.array([5] * len(texts)), "slot": pa.array([0] * len(texts)), "key": pa.array(range(len(texts))), "print": pa.array([7] * len(texts)), "part": pa.array([0] * len(texts), pa.int8()), "normal": texts, "marks": marks})
    rough, met = line_dedup.rough_distance, []
    monkeypatch.setattr(line_dedup, "rough_distance", lambda a, b, most: met.append((a, b)) or rough(a, b, most))
    edges = {frozenset((texts[u], texts[v])) for b in line_dedup.linked(rows.to_batches(), 0.8) for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
    assert edges == {frozenset((t, t[:-3] + "zzz")) for t in one[::6]}
    assert len(met) <= 4 * 7 * 6 // 2 < len(texts) * (len(texts) - 1) // 2


def test_unlike_pairs_are_left_early(monkeypatch):
    """Pairs of all lengths, differences of length and distances in one batch, whenever it is looked for those to leave; and unlike ones take few steps."""
    r, pairs = random.Random(10), []
    for _ in range(150):
        a = "".join(r.choice("abcdé ") for _ in range(r.randint(30, 260)))
        b = list(a) if r.random() < 0.6 else r.choices("abcdé ", k=max(1, len(a) + r.randint(-9, 9)))
        for _ in range(r.randint(0, len(a) // 3)):
            at = r.randrange(len(b) + 1)
            b[at : at + r.randint(0, 1)] = r.choice(["", "x", "a"])
        pairs.append((a, "".join(b) or "y", r.choice((0, 1, 7, len(a) // 5, len(a) // 3))))
    pairs = [p for p in pairs if abs(len(p[0]) - len(p[1])) <= p[2]]
    texts = [[np.array([ord(c) for c in p[i]]) for p in pairs] for i in (0, 1)]
    known = np.unique(np.concatenate(sum(texts, [])))
    texts = [[np.searchsorted(known, t) for t in side] for side in texts]
    want, most = [levenshtein(a, b) for a, b, _ in pairs], np.array([p[2] for p in pairs])
    assert len(pairs) > 80 and 20 < sum(d <= m for d, (*_, m) in zip(want, pairs, strict=True)) < len(pairs) - 20
    for check in (1, 5, 48, 10**6):
        monkeypatch.setattr(line_dedup, "CHECK", check, raising=False)
        got = line_dedup.distances(*texts, len(known), most).tolist()
        assert all(x == d if d <= m else x > m for x, d, m in zip(got, want, most.tolist(), strict=True))
    monkeypatch.setattr(line_dedup, "CHECK", 48)
    take, steps = np.take, []
    monkeypatch.setattr(line_dedup.np, "take", lambda *x, **y: steps.append(1) or take(*x, **y))
    unlike = [("".join(r.choice("abcde") for _ in range(1000)), "".join(r.choice("fghij") for _ in range(1000)), 200) for _ in range(20)]
    assert not any(line_dedup.within_edits(unlike)) and len(steps) < 500


def test_may_align_misses_no_alignment():
    from annolith.llm import chaining

    rng, rows = np.random.default_rng(5), []
    for trial in range(180):
        n, kept = int(rng.integers(30, 140)), rng.choice([1.0, 0.95, 0.85, 0.8])
        one = rng.integers(0, rng.choice([30, 5000]), n).astype("<u4")
        other = np.where(rng.random(n) < kept, one, rng.integers(0, 5000, n)).astype("<u4")
        if trial % 3 == 0:  # a shift, so that the seeds lie on two diagonals
            other = np.insert(other, int(rng.integers(n)), rng.integers(0, 5000, int(rng.integers(1, 9)))).astype("<u4")
        edge = [rng.integers(0, 5000, int(rng.integers(0, 64))).astype("<u4") for _ in range(4)]
        q, r = np.concatenate([edge[0], one, edge[1]]), np.concatenate([edge[2][: len(edge[0])], other, edge[3]])
        both = [(i, j) for i in range(len(q) - 3) for j in range(max(0, i - 70), min(len(r) - 3, i + 70)) if (q[i : i + 4] == r[j : j + 4]).all()]
        pos, rpos = (np.array(x, np.int64) for x in zip(*both, strict=True)) if both else (np.zeros(0, np.int64),) * 2
        rows += [(q, r, pos[c], rpos[c]) for c in chaining.chains(pos, rpos)]
    found = np.array([any(max(e - s, re - rs) >= 50 for s, e, rs, re, _ in chaining.alignments(q, r, p, x, 0.8)) for q, r, p, x in rows])
    straight = np.array([len(p) == len(x) and bool((p == x).all()) for _, _, p, x in rows])
    may = chaining.may_align(pa.array([q.tobytes() for q, *_ in rows], pa.binary()), pa.array([r.tobytes() for _, r, *_ in rows], pa.binary()), straight, 0.8, 50)
    assert found.sum() > 30 and straight.sum() > 30 and (found & ~straight).sum() > 15
    assert not (found & ~may).any()
    # a line of 45 words that two texts share, words apart around it: no row for it
    line, a, b = (rng.integers(0, 1 << 30, k).astype("<u4") for k in (45, 60, 60))
    q, r = (np.concatenate([x, line, x[::-1]]).tobytes() for x in (a, b))
    column = lambda *x: pa.array([b"", *x], pa.binary()).slice(1)
    assert chaining.may_align(column(q, q), column(r, q), np.array([True, True]), 0.8, 50).tolist() == [False, True]
