"""N-gram Jaccard join (operator 13) against brute force."""

import random

import numpy as np
import pytest

from pathglass.llm import bitmaps, ngram_join


def brute_sets(rows, words=5):
    out = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set())
    return out


def brute_components(rows, percent=80, words=5):
    sets = brute_sets(rows, words)
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            x = len(sets[i] & sets[j])
            if x and 100 * x >= percent * (len(sets[i]) + len(sets[j]) - x):
                parent[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[root(i)] = min(key, least.get(root(i), key))
    return sorted(((key, len(sets[i]), least.get(root(i))) for i, (key, _) in enumerate(rows)), key=repr)


def found(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id").collect()), key=repr)


@pytest.fixture(scope="module")
def families():
    """Groups of near copies with shares around the threshold, chains of them, and short texts."""
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(3))
    texts = []
    for n in (4, 5, 6, 8, 9, 12, 30, 80, 200):
        for _ in range(3):
            base = [word() for _ in range(n)]
            texts.append(" ".join(base))
            for _ in range(5):
                w = list(base)
                for _ in range(r.randint(1, max(1, n // 40))):
                    w[r.randrange(len(w))] = word()
                texts.append(" ".join(w[r.choice((0, 0, 1)) :] + [word()] * r.choice((0, 0, 1))))
    chain = [word() for _ in range(60)]
    for _ in range(15):
        chain[r.randrange(60)] = word()
        texts.append(" ".join(chain))
    return list(enumerate(texts, 1000))


@pytest.mark.parametrize("light", [None, 20])
def test_components_equal_brute_force(spark, frame, prose, families, light):
    rows = [*prose, *families, (None, prose[3][1]), (None, families[5][1] + " z"), (None, None), (None, "alone here"), (3, prose[9][1]), (7, prose[9][1]), (7, prose[9][1])]
    got = ngram_join.jaccard_components(frame(rows), light=light)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert found(got) == brute_components(rows)
    assert len({c for _, _, c in found(got)}) > 60


def test_no_rows(spark, frame):
    assert ngram_join.jaccard_components(frame([])).count() == 0
    assert found(ngram_join.jaccard_components(frame([(1, None), (2, "")]))) == [(1, 0, 1), (2, 0, 2)]
    with pytest.raises(ValueError):
        ngram_join.jaccard_components(frame([]), percent=60)


@pytest.mark.parametrize("light", [0, 10**9])
def test_long_lists_lose_no_links(spark, families, light):
    """Lists longer than a leaf: a hot passage, a large group of near copies, and sets that only just link."""
    r = random.Random(22)
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(k, passage + " " + " ".join(str(r.randint(0, 20)) for _ in range(r.randint(4, 12)))) for k in range(80)]
    rows += [(k + 500, " ".join(f"q{j if j != k % 50 else r.random()}" for j in range(50))) for k in range(60)]
    docs = spark.createDataFrame(rows + families, "doc_id long, text string")
    assert found(ngram_join.jaccard_components(docs, leaf=6, light=light)) == brute_components(rows + families)


def test_hot_keys_beyond_the_broadcast(spark, families, monkeypatch):
    from pathglass.llm import common

    monkeypatch.setattr(common, "HOT_KEYS", 3)
    docs = spark.createDataFrame(families, "doc_id long, text string")
    assert found(ngram_join.jaccard_components(docs, percent=90)) == brute_components(families, 90)


def test_long_lists_of_components_are_not_grown(spark, frame, monkeypatch):
    r = random.Random(13)
    make = lambda n: " ".join(str(r.randint(0, 10**9)) for _ in range(n))
    parts = [make(8) for _ in range(10)]
    rows = [(k, " ".join(parts[j] for j in sorted(r.sample(range(10), 4)))) for k in range(120)]
    rows += [(200 + k, f"{rows[k][1]} more") for k in range(20)]
    made = []
    monkeypatch.setattr(ngram_join, "_grow", lambda rows, percent, bound=None, of=ngram_join._grow: made.append(bound) or of(rows, percent, bound))
    assert found(ngram_join.jaccard_components(frame(rows), leaf=4, light=0)) == brute_components(rows)
    assert made == [0]


def test_blocks_hold_every_pair():
    for n, most in ((7, 8), (9, 8), (40, 8), (41, 7), (5, 1), (3, 2)):
        parts = bitmaps.in_blocks(np.arange(n) + 3, most)
        assert all(len(x) <= max(2, most) for x in parts)
        assert {(a, b) for x in parts for a in x.tolist() for b in x.tolist() if a < b} == {(a, b) for a in range(3, n + 3) for b in range(a + 1, n + 3)}


def test_prefixes_hold_the_shared_shingles():
    r = np.random.default_rng(6)
    for _ in range(3000):
        n, percent = int(r.integers(4, 40)), int(r.integers(76, 101))
        a = set(range(n))
        b = set(r.choice(n + 6, int(r.integers(4, n + 6)), replace=False).tolist())
        if 100 * len(a & b) >= percent * len(a | b):
            for share in range(1, ngram_join.DEEPEST + 1):
                first = [set(sorted(s)[: ngram_join.prefix(len(s), share, percent)]) for s in (a, b)]
                assert len(first[0] & first[1]) >= share


def test_boundary_is_where_work_is_least():
    assert ngram_join.boundary([(10, 5, 1), (20, 5, 1)], 80) == 0
    assert ngram_join.boundary([(10, 5, 10**6), (20, 5, 1)], 80) == 10
    assert ngram_join.boundary([(10, 5, 10**6), (20, 5, 10**6)], 80) == 20


def test_forest_joins_what_links():
    r = random.Random(23)
    for _ in range(60):
        sets = [np.array(sorted(r.sample(range(14), r.randint(4, 12))), np.uint64) for _ in range(12)]
        pivots = [r.random() < 0.6 for _ in sets]
        got = ngram_join.link_sets(list(range(12)), sets, pivots, 80)
        rows = [(i, None) for i in range(12)]
        parent = {i: i for i, _ in rows}
        root = lambda k: k if parent[k] == k else root(parent[k])  # noqa: B023, E731
        for a, b in got:
            assert a < b and root(a) != root(b)
            parent[root(a)] = root(b)
        for i in range(12):
            for j in range(i):
                x = len(np.intersect1d(sets[i], sets[j]))
                if (pivots[i] or pivots[j]) and 100 * x >= 80 * (len(sets[i]) + len(sets[j]) - x):
                    assert root(i) == root(j)


def test_bitmaps_rule_out_no_linked_pair():
    r = np.random.default_rng(7)
    for _ in range(40):
        base = r.integers(0, 1 << 64, int(r.integers(5, 400)), np.uint64)
        family = [np.unique(np.append(r.choice(base, int(len(base) * r.uniform(0.8, 1)), replace=False), r.integers(0, 1 << 64, int(r.integers(0, 6)), np.uint64))) for _ in range(6)]
        sets = family + [np.unique(r.integers(0, 1 << 64, len(s), np.uint64)) for s in family]
        bits = np.stack([np.frombuffer(bitmaps.bitmap(s), np.uint64) for s in sets])
        component = r.integers(0, 4, len(sets))
        groups = bitmaps.candidate_groups(np.array([len(s) for s in sets]), bits, component, 80)
        assert all(len(g) > 1 for g in groups) and len(np.concatenate([*groups, []])) == len({k for g in groups for k in g.tolist()})
        for i in range(len(sets)):
            for j in range(i):
                x = len(np.intersect1d(sets[i], sets[j]))
                if component[i] != component[j] and 100 * x >= 80 * (len(sets[i]) + len(sets[j]) - x):
                    assert any({i, j} <= set(g.tolist()) for g in groups)


def test_shingles():
    assert len(ngram_join.shingles("a b c d e f g")) == 3 and len(ngram_join.shingles("a b")) == 1 and not len(ngram_join.shingles(" \x0b\n"))
    assert ngram_join.shingles("A B c d e").tolist() == ngram_join.shingles("a b\tC d e").tolist() != ngram_join.shingles("b a c d e").tolist()
    assert len(ngram_join.shingles("x " * 50)) == 1 and len(ngram_join.shingles("é " * 4 + "É")) == 1
