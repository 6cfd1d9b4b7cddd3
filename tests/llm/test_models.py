"""Held-out accuracy and defined results of the fitted operators."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from samples import words

from fundtrace.llm import language, quality_model, toxicity

STEMS = {"en": "the of and ing tion er on", "de": "der und sch keit ung ein", "fr": "le eau ent que oux ai", "es": "el os ción ado ra ue"}


def sentence(lang, seed, n=40):
    r = np.random.default_rng(seed)
    s = STEMS[lang].split()
    return " ".join("".join(r.choice(s, 1 + r.integers(3))) for _ in range(n))


def test_language(documents):
    rows = [(i, sentence(lang, i), lang) for i, lang in enumerate(["en", "de", "fr", "es"] * 60)]
    odd = [(1000, None, "en"), (1001, "", "fr"), (1002, "12 34 -- !", "de"), (1003, sentence("fr", 5), None), (1004, sentence("de", 1, 20_000), None), (1005, sentence("fr", 5), None)]
    out = {r.doc_id: r for r in language.identify(documents(rows + odd, "lang_pred score")).collect()}
    assert np.mean([out[i].lang_pred == lang for i, _, lang in rows if out[i].held_out]) > 0.95
    assert [out[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3
    assert out[1003].lang_pred == out[1005].lang_pred == "fr" and out[1004].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in out.values())
    kept = {r.doc_id for r in language.accepted(documents(rows + odd)).collect()}
    assert kept == {i for i, r in out.items() if r.lang_pred != "und"}


def test_language_without_labels_and_rows(documents):
    assert [r.lang_pred for r in language.identify(documents([(1, "some text", None)])).collect()] == ["und"]
    assert language.identify(documents([])).count() == 0


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_toxicity(spark, documents):
    bad = ["vilgorn", "skrazzle", "mudfrip"]
    texts, labels = [], []
    for i in range(900):
        toxic = i % 3 == 0
        w = sentence("en", i, 80).split()
        if toxic:
            for k in range(3):
                w[10 + 20 * k] = bad[(i + k) % 3]
        texts.append(" ".join(w))
        labels.append((i, 1, int(toxic)))
    extra = [None, "", "Vilgorn! mudfrip.", sentence("en", 5, 20_000)]
    out = {r.doc_id: r for r in toxicity.score(documents(texts + extra, "toxic score"), labelled(spark, labels)).collect()}
    held = [i for i in range(900) if out[i].held_out]
    assert np.mean([out[i].predicted == labels[i][2] for i in held]) > 0.97
    assert out[900].score == out[901].score and out[900].predicted == 0 and out[902].predicted == 1
    assert all(0 <= r.score <= 1 for r in out.values())


def test_toxicity_without_labels_or_rows(spark, documents):
    none = labelled(spark, [])
    assert [r.score for r in toxicity.score(documents(["a b"]), none).collect()] == [0.0]
    assert toxicity.score(documents([]), none).count() == 0


def spelled(k, n):
    return "".join(chr(97 + k // 26**j % 26) for j in range(n))


def test_toxicity_counts_every_gram(documents):
    """Grams share slots of 20 bits here, and texts lie in other batches."""
    rng = np.random.default_rng(0)
    texts = [" ".join(spelled(k, 6) for k in rng.integers(0, 26**6, 12_000)) for _ in range(60)]
    clean = [b" " + t.encode() + b" " for t in texts]
    codes = {c[i : i + 4] for c in clean for i in range(len(c) - 3)}
    want = {}
    for c in codes:
        key = int.from_bytes(c[1:], "big")
        want[key] = want.get(key, 0) + 1
    for parts in (1, 3):
        assert {r.gram: r.n for r in toxicity.shared_counts(documents(texts).repartition(parts)).collect()} == want


def test_toxicity_looks_grams_up_by_themselves():
    code = np.random.default_rng(1).choice(1 << 40, 300_000, replace=False)
    table = toxicity.Grams(code[:200_000], np.arange(1, 200_001))
    assert (table.at(code.astype(np.uint64)) == np.r_[np.arange(1, 200_001), np.zeros(100_000)]).all()


def test_continuation_is_a_distribution():
    rng = np.random.default_rng(0)
    codes = np.unique(rng.integers(0, 1 << 32, 5000) & 0x0F0F0F0F)
    for context in (0x0101, 0x0A03, 0xFFFF):
        p = toxicity.continuation(codes, (context << 8) + np.arange(256))
        assert abs(p.sum() - 1) < 1e-9 and (p > 0).all()


def test_toxicity_is_plain_kneser_ney(spark, documents):
    """Counts, back-off and log ratios against a computation word by word."""
    texts = [f"{sentence('en', i, 30)} {'Vile' if i % 3 == 0 else 'kind'}-x{i % 7}" for i in range(60)] + ["", " "]
    toxic = [int(i % 3 == 0) for i in range(62)]
    docs = documents(texts)
    every = shared = sorted((r.gram, r.n) for r in toxicity.shared_counts(docs).collect())
    broadcast = spark.sparkContext.broadcast(tuple(np.array(c, np.int64) for c in zip(*shared)))
    rows = docs.join(spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int"), "doc_id").select("doc_id", "text", "toxic")
    got = toxicity.class_counts(rows.repartition(3), broadcast).toPandas()

    split = [set(re.sub("[^a-z]+", " ", t.lower()).split()) for t in texts]
    count = [Counter(w for s, y in zip(split, toxic) if y == c for w in s) for c in (0, 1)]
    vocabulary = sorted(set(count[0]) | set(count[1]))
    three, two = dict(every), Counter(g & 0xFFFF for g, _ in every)
    one = Counter(g & 0xFF for g in two)

    def byte(context, b):
        p = (one[b] + 0.5) / (sum(one.values()) + 128)
        for table, c in ((two, context[-1:]), (three, context)):
            mine = {g: n for g, n in table.items() if g >> 8 == int.from_bytes(c, "big")}
            if mine:
                p = (max(mine.get((int.from_bytes(c, "big") << 8) + b, 0) - 0.75, 0) + 0.75 * len(mine) * p) / sum(mine.values())
        return p

    def spelt(w):
        s = b"  " + w.encode() + b" "
        return math.prod(byte(s[i - 2 : i], s[i]) for i in range(2, len(s)))

    def likelihood(c, w):
        n = count[c]
        kinds = [max(sum(v == k for v in n.values()), 1) for k in (1, 2, 3, 4)]
        y = kinds[0] / (kinds[0] + 2 * kinds[1])
        off = [min(max(k + 1 - (k + 2) * y * kinds[k + 1] / kinds[k], 0.1), most) for k, most in enumerate((0.95, 1.9, 2.85))]
        take = lambda v: off[min(v, 3) - 1] if v else 0
        base = 0.5 * spelt(w) + 0.5 / len(vocabulary)
        return (n[w] - take(n[w]) + sum(map(take, n.values())) * base) / sum(n.values())

    want = {w: (count[1][w], count[0][w], math.log(spelt(w)), math.log(likelihood(1, w) / likelihood(0, w))) for w in vocabulary}
    ratios = toxicity.log_ratios(got["t"].to_numpy(), got["o"].to_numpy(), got["bytes"].to_numpy())
    found = sorted(zip(got["t"], got["o"], got["bytes"], ratios))
    assert np.allclose(found, sorted(want.values()), rtol=0, atol=1e-9) and len(found) == len(vocabulary)
    assert max(want, key=lambda w: want[w][3]) == "vile"
    # A distribution, but for words that neither class has.
    assert 0.45 < sum(likelihood(1, w) for w in vocabulary) <= 1 + 1e-9


def test_toxicity_on_the_given_table(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").groupBy("doc_id").agg({"toxic": "max"}).withColumnRenamed("max(toxic)", "toxic")
    held = toxicity.query(spark, folder).filter("held_out").join(labels, "doc_id").select("toxic", "predicted").toPandas()
    assert (held.toxic == held.predicted).mean() > 0.97 and held.predicted[held.toxic == 1].mean() >= 0.9


def test_toxicity_of_repeated_rows_and_long_texts(spark, documents):
    texts = [f"{sentence('en', i, 30)} {'vile vile' if i % 3 == 0 else 'kind'}" for i in range(90)]
    docs = documents(texts + [sentence("en", 1, 50_000) + " vile"])
    labels = labelled(spark, [(i, 1, int(i % 3 == 0)) for i in range(90)] * 2)
    out = toxicity.score(docs.union(docs), labels).toPandas()
    assert len(out) == 182 and (out.groupby("doc_id").score.nunique() == 1).all() and out[out.doc_id == 90].predicted.eq(1).all()


def test_quality_grades(spark, documents):
    texts, rows = [], []
    for i in range(600):
        g = i % 3
        texts.append(sentence("en", i) if g == 2 else sentence("en", i).upper() if g == 1 else sentence("en", i).replace(" ", "## %% "))
        rows.append((i, g))
    out = {r.doc_id: r for r in quality_model.grade(documents([*texts, None, ""], "grade kept"), spark.createDataFrame(rows, "doc_id long, grade int")).collect()}
    held = [i for i in range(600) if out[i].held_out]
    assert np.mean([round(out[i].expected_grade) == i % 3 for i in held]) > 0.95
    assert all(out[i].p_ge_1 >= out[i].p_ge_2 for i in out) and out[600].p_ge_1 == out[601].p_ge_1
    assert quality_model.grade(documents([]), spark.createDataFrame([], "doc_id long, grade int")).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_linear_svm_separates(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(200, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.where(x[:, 0] + 0.5 * x[:, 1] > 0, 1, -1).astype(np.float32)
    w = language.linear_svm(x, y, steps=600)
    assert np.mean(np.sign(x @ w[:-1] + w[-1]) == y) > 0.97


def test_words_helper_is_stable():
    assert words(1, 3) == words(1, 3)
