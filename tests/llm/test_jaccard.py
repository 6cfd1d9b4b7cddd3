import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from samples import corpus, edited, words

from fundtrace.llm import jaccard


def brute(rows):
    lower = {c: c + 32 for c in range(65, 91)}
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
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
        common = Counter(e for x in s for e in where[x] if e > d)
        for e, k in common.items():
            if 100 * k >= 75 * (len(s) + len(sets[e]) - k):
                a, b = find(d), find(e)
                root[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_components_equal_brute_force(documents):
    df = documents(corpus(), "component set_id n_shingles")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert got(jaccard.join(df)) == brute(rows)


def test_frequent_keys_are_settled_in_blocks(documents, monkeypatch):
    """Many near copies at the threshold: the first comparison leaves some open."""
    base = words(3, 60, 10**6)
    df = documents([edited(base, 0.015 * (k % 5), k) for k in range(120)])
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert got(jaccard.join(df)) == brute(rows)


def test_empty_table_and_repeated_rows(documents):
    assert jaccard.join(documents([])).count() == 0
    rows = jaccard.join(documents([(4, "a b c d e f", "en"), (4, "a b c d e f", "en")])).collect()
    assert [tuple(r) for r in rows] == [(4, 2, 4), (4, 2, 4)]
    rows = jaccard.join(documents([(None, "a b c", "en"), (7, "a b c", None), (None, "x y", "en"), (None, None, "en")])).collect()
    assert sorted((tuple(r) for r in rows), key=str) == sorted([(None, 1, 7), (7, 1, 7), (None, 1, None), (None, 0, None)], key=str)


def test_passages_that_many_texts_have(documents, monkeypatch):
    """Half of each text is one passage, so its keys are frequent and can't all be left out; some texts are near copies besides."""
    passage = words(8, 60, 10**6)
    texts = [words(500 + k // 2, 50, 10**6) + " " + passage + (" x" * (k % 2)) for k in range(160)]
    df = documents(texts + [edited(texts[0], 0.02, k) for k in range(30)])
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    asked = []
    rarest = jaccard._rarest
    monkeypatch.setattr(jaccard, "_rarest", lambda *a: asked.append(1) or rarest(*a))
    assert got(jaccard.join(df)) == brute(rows) and asked


def test_sets_that_one_hash_takes_for_equal():
    """Their second hash tells them apart; all others keep their id."""
    first, second = np.array([5, 5, 9], np.uint64), np.array([1, 2, 3], np.uint64)
    assert jaccard._named(first, second, np.zeros(0, np.int64)).tolist() == [5, 5, 9]
    a, b, c = jaccard._named(first, second, np.array([5])).tolist()
    assert a != b and c == 9


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13, 40, 200])
def test_linked_sets_share_a_key(n):
    """Of two sets at the threshold one key is the same, for sets of any size and any difference."""
    rng = np.random.default_rng(n)
    for trial in range(30):
        union = rng.integers(0, 1 << 63, max(1, round(n)), dtype=np.uint64)
        gone = int(len(union) * 0.25)
        split = rng.integers(0, gone + 1)
        x, y = np.sort(union[split:]), np.sort(np.delete(union, np.arange(split, gone)))
        if 100 * (len(union) - gone) < 75 * len(union) or not len(x) or not len(y):
            continue
        assert jaccard.may_link(*(jaccard.sketches(np.zeros(len(s), np.int64), s, np.array([len(s)]))[0].tobytes() for s in (x, y)), len(x), len(y))
        if np.array_equal(x, y):  # one class from the start
            continue
        keys = []
        for s in (x, y):
            of = np.zeros(len(s), np.int64)
            _, key, kind, _ = jaccard.keys_of(of, s, np.array([len(s)]))
            keys.append(set(zip(key.tolist(), kind.tolist())))
        assert keys[0] & keys[1]
