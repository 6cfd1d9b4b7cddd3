"""Components against comparing all pairs, and what odd sketches say about similarity."""

import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from samples import corpus, edited, words

from fundtrace.llm import jaccard, odd_sketches


def brute(rows):
    lower = {c: c + 32 for c in range(65, 91)}
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[d] = frozenset(tuple(w[i : i + 2]) for i in range(max(1, len(w) - 1))) if w else frozenset()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            where[x].append(d)
    for d, s in sets.items():
        for e, k in Counter(e for x in s for e in where[x] if e > d).items():
            if 100 * k >= 80 * (len(s) + len(sets[e]) - k):
                a, b = find(d), find(e)
                root[max(a, b)] = min(a, b)
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_components_equal_brute_force(documents):
    df = documents(corpus(), "component set_id keys")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    want = brute(rows)
    assert got(odd_sketches.near_duplicates(df)) == want and len({v[1] for v in want.values()}) < len(want) - 50


def test_large_groups_at_the_threshold(documents, monkeypatch):
    """Members of one key that link with some of each other only, in more sets than are paired at once."""
    base = words(3, 60, 10**6)
    df = documents([edited(base, 0.02 * (k % 6), k) for k in range(120)])
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert got(odd_sketches.near_duplicates(df)) == brute(rows)


def test_nulls_repeated_rows_and_empty_table(documents):
    assert odd_sketches.near_duplicates(documents([])).count() == 0
    rows = odd_sketches.near_duplicates(documents([(4, "a b c", "en"), (4, "a b c", "en"), (None, "A B C", None), (None, "x y", "en"), (9, None, "en"), (8, " \t", "en")])).collect()
    assert sorted(map(str, (tuple(r) for r in rows))) == sorted(map(str, [(4, 2, 4, True), (4, 2, 4, True), (None, 2, 4, False), (None, 1, None, False), (9, 0, 9, True), (8, 0, 8, True)]))


@pytest.mark.parametrize("share", [0.95, 0.9, 0.8, 0.6, 0.3])
def test_estimates_are_near_the_similarity(share):
    """Of sets of 2 000; the filter keeps all at 0.8 or more and drops what is far below."""
    r, size, differences = np.random.default_rng(int(share * 100)), 2000, []
    common = round(2 * size * share / (1 + share))
    for _ in range(30):
        h = np.unique(r.integers(0, 1 << 63, 3 * size, dtype=np.uint64))
        r.shuffle(h)
        x, y = h[:size], np.r_[h[:common], h[size : 2 * size - common]]
        sketch = odd_sketches.odd_sketches(odd_sketches.samples(np.r_[x, y], np.array([size, size]))).view(np.uint64)
        differences.append(int(np.bitwise_count(sketch[0] ^ sketch[1]).sum()))
    differences = np.array(differences)
    most = odd_sketches._most_parities(80)
    assert (differences <= most).all() if share >= 0.8 else (differences > most).all() if share < 0.5 else True
    if share >= 0.8:
        assert abs(odd_sketches.estimate(differences).mean() - share) < 0.02


def test_equal_sets_have_equal_samples_whatever_stands_beside_them():
    h = np.arange(1, 9, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    both = odd_sketches.samples(np.r_[h[:5], h[5:], h[:5]], np.array([5, 3, 5]))
    assert (both[0] == both[2]).all() and (odd_sketches.band_keys(both)[0] == odd_sketches.band_keys(both)[2]).all() and (both[0] != both[1]).any()
    assert len(np.unique(odd_sketches.band_keys(both)[0])) == odd_sketches.BANDS


def test_open_groups_are_gone_on_with_once_and_in_blocks_of_sketches(documents, monkeypatch):
    """Before, after the first bands and again after all, with all shingles of all pairs of blocks."""
    base, times = words(3, 60, 10**6), []
    df = documents([edited(base, 0.02 * (k % 6), k) for k in range(120)])
    finish, blocks = odd_sketches.finished, odd_sketches._block_pairs
    monkeypatch.setattr(odd_sketches, "finished", lambda *a: (times.append("finished"), finish(*a))[1])
    monkeypatch.setattr(odd_sketches, "_block_pairs", lambda *a: (times.append("blocks"), blocks(*a))[1])
    monkeypatch.setattr(odd_sketches, "BLOCK", 16)
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert got(odd_sketches.near_duplicates(df)) == brute(rows)
    assert times.count("finished") == 1 and times.count("blocks") <= 1


@pytest.mark.parametrize("at_once,compared,tokens", [(1 << 18, 1 << 20, 1 << 14), (100, 7, 64)])
def test_links_of_blocks_equal_comparing_all_pairs(monkeypatch, at_once, compared, tokens):
    for name, value in (("AT_ONCE", at_once), ("COMPARED", compared), ("TOKENS", tokens)):
        monkeypatch.setattr(odd_sketches, name, value)
    r = np.random.default_rng(5)
    pools, rows = [np.unique(r.integers(0, 1 << 63, 150, dtype=np.uint64)) for _ in range(3)], []
    for k in range(90):
        h = np.sort(np.r_[r.choice(pools[k % 3], 130 + k % 20, replace=False), r.integers(0, 1 << 63, k % 7, dtype=np.uint64)])
        sketch = odd_sketches.odd_sketches(odd_sketches.samples(h, np.array([len(h)])))[0].tobytes()
        rows.append((k % 2, k, k // 4, len(h), sketch, h.tobytes(), set(h.tolist())))
    df = pd.DataFrame([x[:6] for x in rows], columns=["side", "set_id", "component", "n", "sketch", "hashes"])
    linked = lambda x, y: 100 * len(x & y) >= 80 * len(x | y)
    want = {(x[1], y[2]) for x in rows for y in rows if x[0] == 0 and y[0] == 1 and x[2] != y[2] and linked(x[6], y[6])}
    links = odd_sketches._block_links(df, 80, odd_sketches._most_parities(80))
    assert {(a, b // 4) for a, b in links.itertuples(index=False)} == want and len(links) == len(want) > 100
    assert all(linked(rows[a][6], rows[b][6]) for a, b in links.itertuples(index=False))
    for k in (0, 1):
        assert len(odd_sketches._block_links(df[df["side"] == k], 80, 165)) == 0
