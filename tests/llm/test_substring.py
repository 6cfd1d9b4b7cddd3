import hashlib
import re
from collections import Counter

import numpy as np
from samples import corpus, words

from fundtrace.llm import substring


def brute(rows):
    texts = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    count = Counter(tuple(w[i : i + 35]) for _, w in texts for i in range(len(w) - 34))
    out = []
    for d, w in texts:
        gone = {p for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for p in range(i, i + 35)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def check(df):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    result = substring.dedup(df)
    assert sorted(tuple(r)[:4] for r in result.collect()) == brute(rows)


def test_equals_brute_force(documents):
    periodic = " ".join(["a"] * 90), " ".join(["b c"] * 40)
    check(documents([*corpus(), *periodic, words(1, 34), words(2, 35), words(2, 35)], "key content rid start"))


def test_crowded_grams(documents, monkeypatch):
    monkeypatch.setattr(substring, "CROWDED", 5)
    monkeypatch.setattr(substring, "SHARD", 10)
    check(documents(corpus()))


def test_equal_ids_with_different_texts_and_empty_table(documents):
    long = words(1, 50, 10**6)
    check(documents([(1, long, "en"), (1, "short text", "en"), (2, long, "en")]))
    assert substring.dedup(documents([])).count() == 0


def test_wavelet_matrix_ranks():
    rng = np.random.default_rng(0)
    s = rng.integers(0, 11, 500)
    w = substring.WaveletMatrix(s, 11)
    c, i = rng.integers(0, 11, 300), rng.integers(0, 501, 300)
    assert (w.rank(c, i) == [(s[:j] == k).sum() for k, j in zip(c, i)]).all()


def test_matching_statistics():
    rng = np.random.default_rng(1)
    parts = [rng.integers(1, 4, n).astype(np.uint64) for n in (20, 31, 8, 44)]
    index = substring.ShardIndex(parts, np.ones(4, np.int64))
    whole = [p.tolist() for p in parts]

    def occurs(x):
        return sum(p[i : i + len(x)] == x for p in whole for i in range(len(p) - len(x) + 1))

    stats = index.statistics()
    for b, p in zip(index.begin, whole):
        for i in range(len(p)):
            n = 0
            while i + n < len(p) and occurs(p[i : i + n + 1]) >= 2:
                n += 1
            assert stats[b + i] == n
