"""Decontamination, quality rules and licence scans."""

import hashlib
import math

from samples import corpus, words

from fundtrace.llm import decontaminate, licences, quality_rules


def brute_hits(text, items):
    w = [x.decode() for x in decontaminate.normalised(text)]
    hit, names = set(), set()
    for item, t in items:
        b = [x.decode() for x in decontaminate.normalised(t)]
        for j in range(max(1, len(b) - 12) if b else 0):
            win = b[j : j + 13]
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit.update(range(i, i + len(win)))
                    names.add(str(item))
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def test_decontamination_equals_brute_force(spark, documents):
    passage = words(1, 30, 10**6)
    items = [(1, passage), (10, "Ünïque short"), (2, "ab ab ab ab ab ab ab ab ab ab ab ab ab"), (3, None), (4, " .,- "), (5, passage)]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS n_words", "2 AS spans")
    inside = " ".join(passage.split()[5:20])
    texts = [None, "", "..", passage, passage.upper().replace(" ", "--"), words(2, 200) + " " + inside, words(3, 900, 10**6) + " " + inside, "an Ünïque, short one", "ünïque short", "ab " * 15, " ".join(passage.split()[:12])]
    df = documents(texts, "items spans contaminated")
    for limit in (10**6, 3):
        got = {r.doc_id: tuple(r)[1:6] for r in decontaminate.decontaminate(df, bench, limit).collect()}
        assert got == {d: brute_hits(t, items) for d, t in enumerate(texts)}
    assert decontaminate.decontaminate(documents([]), bench).count() == 0
    none = decontaminate.decontaminate(df, bench.limit(0)).collect()
    assert len(none) == len(texts) and all(r.n_hit == 0 and not r.contaminated for r in none)


def test_decontamination_answers_every_row_in_rounds(spark, documents):
    a, b, c = words(1, 30, 10**6), words(2, 30, 10**6), words(3, 20, 10**6)
    items = [(1, a), (2, b), (None, c)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(None, a), (None, b + " " + words(4, 900, 10**6)), (None, "none of it"), (7, a), (7, "clean"), (7, a), (8, c), (None, None), (None, None)]
    named = [(i, t) for i, t in items if i is not None]
    def want(d, t):
        n, hit, _, _, over = brute_hits(t, items)
        return d, n, hit, *brute_hits(t, named)[2:4], over
    df = documents([(d, t, "en") for d, t in rows])
    whole, parts = (decontaminate.decontaminate(df, bench, limit).collect() for limit in (10**6, 3))
    assert sorted((tuple(r)[:6] for r in whole), key=str) == sorted((want(d, t) for d, t in rows), key=str)
    assert sorted(map(tuple, parts), key=str) == sorted(map(tuple, whole), key=str)
    by_size = decontaminate.decontaminate(df, bench, max_size=1500).collect()
    assert sorted(map(tuple, by_size), key=str) == sorted(map(tuple, whole), key=str)


def brute_measures(t):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    places = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(places), len(w) < 10 or 100 * len(places) > 20 * len(w)


def test_measures(spark, documents):
    texts = [None, "", " \n\n", "a b c d e " * 5, "x\nx\n x\nx", "über # * 12 <b>\nあ y z\n", words(1, 300, 20), "a b c d e f a b c d e", *[t for t in corpus()[:30]]]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.quality_rules(documents(texts, "stratum words"), labels).collect()}
    assert got == {d: brute_measures(t) for d, t in enumerate(texts)}
    assert quality_rules.quality_rules(documents([]), labels).count() == 0


def test_cutoffs_keep_their_guarantee(spark, documents):
    """Symbols tell bad from good in one language, in the other nothing may be rejected: too few labels."""
    n = 3000
    texts = [(i, words(i, 30, 10**6) + (" ## ## ## ## ##" if i % 3 == 0 else ""), "en") for i in range(n)] + [(n + i, words(i, 30) + " ####", "de") for i in range(60)]
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(n)] + [(n + i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in quality_rules.quality_rules(documents(texts), labels).collect()}
    assert all(not rows[i].kept and rows[i].failed_rules for i in range(0, n, 3))
    assert sum(not rows[i].kept for i in range(n) if i % 3) <= 0.05 * n
    assert all(rows[n + i].kept for i in range(60))


def test_binomial_tail(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0, 10.0), (3, 40.0), (7, 1000.0)], "k long, n double")
    for r in df.select("k", "n", quality_rules._binomial_tail(F.col("k"), F.col("n"), 0.01).alias("t")).collect():
        want = sum(math.comb(int(r.n), j) * 0.01**j * 0.99 ** (r.n - j) for j in range(r.k + 1))
        assert abs(math.exp(r.t) - want) < 1e-9


def test_licences(documents):
    notice = licences.TEMPLATES["Apache-2.0"][1]
    texts = [None, "", "plain text without any", "Released under the MIT License.", "x y z\nReleased under the  MIT  license\nmore", notice.replace(". ", ".\n"), f"intro here\n\n{notice.replace('. ', chr(10))}\n\nend", "MIT", words(3, 500) + "\nLicensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.",
             "This file is part of foo. Released under the MIT License. Copyright 2020 Jane Doe.", "Code: Released under the MIT License, see LICENSE.", words(5, 40_000) + " " + licences.TEMPLATES["MIT"][2] + " " + words(6, 300)]
    got = {r.doc_id: (r.n_notices, r.licences) for r in licences.licence_scan(documents(texts, "unit licence dice template")).collect()}
    assert {d: got[d][1] for d in (0, 1, 2, 7)} == {0: "", 1: "", 2: "", 7: ""}
    assert got[3] == got[4] == got[9] == got[10] == got[11] == (1, "MIT") and got[5] == got[6] == (1, "Apache-2.0") and got[8] == (2, "CC-BY-NC-4.0")
    assert licences.licence_scan(documents([])).count() == 0


def test_licence_scan_answers_each_row(documents):
    """Rows that share a doc_id, or have none, don't see each other's notices."""
    rows = [(1, "Released under the MIT License.", "en"), (1, "Licensed under CC BY 4.0.", "en"), (1, "nothing here", "en"), (None, "Released under the MIT License.", "en"), (None, None, "en")]
    got = sorted(((r.doc_id, r.n_notices, r.licences, r.best_dice) for r in licences.licence_scan(documents(rows)).collect()), key=str)
    assert got == sorted([(1, 1, "MIT", 1.0), (1, 1, "CC-BY-4.0", 1.0), (1, 0, "", None), (None, 1, "MIT", 1.0), (None, 0, "", None)], key=str)


def test_every_template_is_found_and_close_ones_told_apart(documents):
    """With every twentieth word replaced something is found still; CC BY, BY-SA and BY-NC, and GPL, LGPL and AGPL, differ in a word or two."""
    whole = [(k, t) for k, ts in licences.TEMPLATES.items() for t in ts]
    changed = [(k, " ".join("xyz" if i % 20 == 10 else w for i, w in enumerate(t.split()))) for k, t in whole if len(t.split()) > 24]
    rows = whole + changed
    got = {r.doc_id: [n.licence for n in r.notices] for r in licences.licence_scan(documents([f"{words(i, 30)} {t} {words(i + 1, 30)}" for i, (_, t) in enumerate(rows)])).collect()}
    assert [got[i][:1] for i in range(len(whole))] == [[k] for k, _ in whole]
    assert all(got[i] for i in range(len(whole), len(rows)))
