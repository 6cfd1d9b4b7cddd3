"""Small texts with the awkward cases: null, empty, very long, repeated, ties, near copies."""

import random


def words(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def edited(text, share, seed):
    r = random.Random(seed)
    return " ".join(f"x{r.randrange(10**6)}" if r.random() < share else w for w in text.split())


def corpus():
    base = [words(i, n, 5000) for i, n in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 15, 20, 30, 60, 120, 400])]
    rows = [None, "", "   \n\t ", *base, *base[:6]]
    for i, b in enumerate(base):
        rows += [edited(b, s, 100 * i + k) for k, s in enumerate((0.01, 0.03, 0.06))]
        w = b.split()
        rows += [" ".join(w[:-1]), " ".join(w[1:]), b + " more", b.upper()]
    rows.append(words(77, 30_000, 10**6))
    hot = words(5, 80, 10**6)
    rows += [edited(hot, 0.02, k) for k in range(60)] + [hot] * 20
    passage = words(9, 60, 10**6)
    rows += [words(1000 + k, 50, 10**6) + " " + passage + " " + words(2000 + k, 40, 10**6) for k in range(40)]
    return rows
