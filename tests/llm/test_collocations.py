"""Phrases against counting them one by one."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from fundtrace.llm import collocations


def brute(rows, least, most=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang or "und", tuple(w[i : i + k])] += 1
    f = {g: x for g, x in f.items() if x >= least}
    longer = defaultdict(int)
    for (lang, g), x in f.items():
        for k in range(2, len(g)):
            for i in range(len(g) - k + 1):
                longer[lang, g[i : i + k]] = max(longer[lang, g[i : i + k]], x)
    by = defaultdict(list)
    for (lang, g), a in f.items():
        if len(g) > 1 and longer[lang, g] < a:
            cuts = [(1000 * a * n[lang] // (f[lang, g[:c]] * f[lang, g[c:]]), c) for c in range(1, len(g))]
            score, c = min(cuts)
            by[lang].append((-score, -a, " ".join(g).encode(), f[lang, g[:c]], f[lang, g[c:]]))
    return {(lang, i): (p.decode(), -a, x, y, n[lang], -s) for lang, rows in by.items() for i, (s, a, p, x, y) in enumerate(sorted(rows)[:most], 1)}


def got(df):
    return {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


def texts():
    r = random.Random(3)
    fixed = ["New York", "in the end", "of the same kind of thing", "Été été", "a a a a a a"]
    rows = []
    for k in range(60):
        words = []
        for _ in range(r.randrange(0, 60)):
            words.append(r.choice(fixed) if r.random() < 0.3 else f"w{r.randrange(30)}")
            if r.random() < 0.1:
                words[-1] += r.choice([".", ",", ";\n", "!", "?", "\r", "\t"])
        rows.append((k, " ".join(words), r.choice(["en", "de", None])))
    return rows + [(90, None, "en"), (91, "", None), (92, ".. ,,", "fr"), (5, rows[5][1], "en"), (5, rows[5][1], "en"), (93, " ".join(["long tail"] * 20_000), "fr"), (None, "in the end", "en")]


@pytest.mark.parametrize("burst, most, keys", [(1 << 16, 1 << 20, 1 << 23), (8, 64, 1 << 23), (2, 8, 10)])
def test_equals_counting_one_by_one(documents, monkeypatch, burst, most, keys):
    """Whether containers burst and subtrees spill or not, and in one round or many."""
    monkeypatch.setattr(collocations.HatTrie, "BURST", burst)
    monkeypatch.setattr(collocations.HatTrie, "MOST", most)
    monkeypatch.setattr(collocations, "ROUND_KEYS", keys)
    rows = texts()
    want = brute([(t, lang) for _, t, lang in rows], 5)
    assert got(collocations.collocations(documents(rows, "phrase k f"), 2000, 5)) == want and len(want) > 40


def test_words_are_numbered_anew_when_they_are_many(documents, monkeypatch):
    monkeypatch.setattr(collocations, "MOST_NAME_BYTES", 20)
    rows = texts()[:30]
    assert got(collocations.collocations(documents(rows), 7, 3)) == brute([(t, lang) for _, t, lang in rows], 3, 7)


def test_empty_table_and_one_word(documents):
    assert collocations.collocations(documents([])).count() == 0
    assert collocations.collocations(documents([(1, "one", "en")]), least=1).count() == 0


def test_trie_bursts_by_first_then_second_word_and_spills_sorted_runs(monkeypatch):
    monkeypatch.setattr(collocations.HatTrie, "BURST", 16)
    monkeypatch.setattr(collocations.HatTrie, "MOST", 100)
    trie, r = collocations.HatTrie(), np.random.default_rng(1)
    w = r.integers(1, 9, (400, 3)).astype(np.uint64)
    shift = np.uint64(collocations.WORD_BITS)
    for part in np.array_split(w, 20):
        trie.add(np.vstack([(part[:, 0] << shift) | part[:, 1], part[:, 2], part[:, 0] * np.uint64(100) + part[:, 1] * np.uint64(10) + part[:, 2], np.ones(len(part), np.uint64)]))
    assert len(trie.bounds) > 8 and (np.diff(trie.bounds.astype(np.int64)) > 0).all()
    some, rest = list(trie.spilled(50)), None
    assert some and 0 < trie.size <= 50
    rest = list(trie.spilled(0))
    assert trie.size == 0 and all((np.diff(run[0].astype(np.int64)) >= 0).all() for run in some + rest)
    total = Counter()
    for run in some + rest:
        for g, n in zip(run[2].tolist(), run[3].tolist()):
            total[g] += n
    assert total == Counter((w @ np.array([100, 10, 1], np.uint64)).tolist())


def test_scores_beyond_64_bits(spark):
    """1000 * a * n has over 64 bits here."""
    row = spark.sql("SELECT (CAST(1000 * 5000000000 AS DECIMAL(19, 0)) * CAST(90000000000000001 AS DECIMAL(19, 0))) div (CAST(6000000001 AS DECIMAL(19, 0)) * CAST(7000000003 AS DECIMAL(19, 0))) AS s").first()
    assert row.s == 1000 * 5_000_000_000 * 90_000_000_000_000_001 // (6_000_000_001 * 7_000_000_003)
