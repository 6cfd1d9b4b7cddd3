"""Near words, forms and roots against comparing all pairs of words."""

import random
import re
import zlib
from collections import Counter

from fundtrace.llm import spelling


def brute(rows):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            if doc_id is not None and (h := zlib.crc32(f"{doc_id}:{run}".encode())) % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                total[run] += 1
    words = {w: n for w, n in total.items() if n >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    around = {w: [v for v in words if v != w and near(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(around[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(around[w]), form[w] and words[form[w]])
    return out


def got(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def many_words():
    r = random.Random(5)
    base = ["".join(r.choice("abcéÿ") for _ in range(r.randrange(4, 9))) for _ in range(60)]
    text = ["qrstu"] * 5 + ["qrstuv"] * 14 + ["qrstuvw"] * 50
    for w in base:
        for _ in range(r.choice([1, 3, 6, 12, 24, 50])):
            v = w
            if r.random() < 0.4:
                i = r.randrange(len(w))
                v = r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice("abc") + w[i:], w[:i] + r.choice("abc") + w[i + 1 :]])
            text.append(v)
    r.shuffle(text)
    return text


def test_equals_all_pairs(documents):
    text = many_words()
    rows = [(i, " ".join(text[i::40]), "en") for i in range(40)]
    rows += [(None, "ABCDE abcdÉ Abcde", "en"), (100, None, None), (101, "", "en"), (3, rows[3][1], "de"), (3, rows[3][1], "en")]
    want = brute([(d, t) for d, t, _ in rows])
    assert got(spelling.variants(documents(rows, "word id form"))) == want
    assert any(v[0] for v in want.values()) and want["qrstu"][:2] == ("qrstuv", "qrstuvw")


def test_runs_lose_a_letter_only_where_97_divides_the_crc():
    hit = next(w for w in ("".join(random.Random(k).choices("abcdefgh", k=7)) for k in range(5000)) if zlib.crc32(f"7:{w}".encode()) % 97 == 0)
    at = zlib.crc32(f"7:{hit}".encode()) % 7
    assert spelling.degraded(7, hit) == hit[:at] + hit[at + 1 :] and spelling.degraded(None, hit) == hit


def test_very_long_words_and_texts(documents, monkeypatch):
    """Long prefixes are told apart by their hashes, shared nodes are broadcast or not, and counts are given in parts."""
    long = "".join(random.Random(2).choices("xyz", k=3000))
    other = long[:1500] + "q" + long[1501:]
    docs = documents([(1, " ".join([long] * 3 + [other] * 7 + ["words"] * 20_000 + ["wordz"] * 3), "en")])
    keep = lambda doc_id, run: run
    for most, share in ((200_000, 1 / 4096), (1, 1.0), (1, 0.0001)):
        monkeypatch.setattr(spelling, "MOST_WORDS", most)
        monkeypatch.setattr(spelling, "SHARE", share)
        found = got(spelling.variants(docs, keep))
        assert found == {long: (other, other, 3, 1, 7), other: (None, other, 7, 1, None), "words": (None, "words", 20_000, 1, None), "wordz": ("words", "words", 3, 1, 20_000)}


def test_ties_and_empty_table(documents):
    docs = documents([(1, "aaaab " * 4 + "aaaac " * 8 + "aaaad " * 8 + "aaaa " * 9, "en")])
    found = got(spelling.variants(docs, lambda doc_id, run: run))
    assert found["aaaab"] == ("aaaac", "aaaac", 4, 2, 8) and found["aaaac"][0] is None
    assert spelling.variants(documents([])).count() == 0
