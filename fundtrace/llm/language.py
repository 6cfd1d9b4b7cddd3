"""Language identification in two levels: the family first, then one-versus-one linear SVMs within it.

The features are hashed byte n-grams of the whole text. The machines are fitted on at most about PER_LANGUAGE documents
of each language (a bounded sample by a hash of doc_id) whose id isn't held out; families come from a table of common
ISO codes, and a language that the table lacks is a family of its own.

A null text, or one without a letter, is `und` with score 0. Without labelled rows everything is `und`. Equal texts get
equal predictions; a tie goes to the language that sorts first.
"""

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundtrace.llm.features import VECTOR_ROWS, held_out, sample_vectors, sampled, text_rows, vectors
from fundtrace.llm.store import small_batches, thrifty
from fundtrace.llm.text import pieces

PER_LANGUAGE = 1200
# Families of common languages by ISO code.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi", "romance": "fr es it pt ro ca gl oc", "slavic": "ru uk pl cs sk bg sr hr sl mk be bs",
    "uralic": "fi et hu", "turkic": "tr az kk uz ky tk", "indic": "hi bn mr ne ur pa gu", "sinitic": "zh yue wuu",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def linear_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, steps: int = 150) -> np.ndarray:
    """Weights and bias of a squared-hinge linear SVM; y is -1 or 1, both sides weigh the same. Accelerated gradient."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = before = np.zeros(x.shape[1] + 1, np.float32)
    rate = 1.0 / (2.0 * 2.0 + penalty)
    for i in range(steps):
        ahead = w + i / (i + 3) * (w - before)
        pull = share * y * np.maximum(0, 1 - y * (x @ ahead[:-1] + ahead[-1]))
        before, w = w, ahead - rate * (penalty * ahead - 2 * np.append(pull @ x, pull.sum()))
    return w


def fit(x: np.ndarray, langs: list[str]) -> dict:
    """Machines by level; each is (first, second, weights): positive for the first."""
    names = np.array(langs)
    family = np.array([FAMILY_OF.get(lang, lang) for lang in langs])
    groups = {f: sorted(set(names[family == f])) for f in sorted(set(family))}
    between = [(a, b, linear_svm(x[(m := (family == a) | (family == b))], np.where(family[m] == a, 1, -1).astype(np.float32))) for a, b in combinations(groups, 2)]
    within = {f: [(a, b, linear_svm(x[(m := (names == a) | (names == b))], np.where(names[m] == a, 1, -1).astype(np.float32))) for a, b in combinations(ls, 2)] for f, ls in groups.items()}
    return {"groups": groups, "between": between, "within": within}


def _vote(choices: list[str], machines: list, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The choice with the most won comparisons, then the largest sum of margins; and a share in 0 to 1 for it."""
    if len(choices) == 1:
        return np.zeros(len(x), np.int64), np.ones(len(x))
    wins, sums, sure = (np.zeros((len(x), len(choices))) for _ in range(3))
    sure += 1
    for a, b, w in machines:
        margin = x @ w[:-1] + w[-1]
        p = 1 / (1 + np.exp(-4 * np.clip(margin, -20, 20)))
        for k, m, q in ((choices.index(a), margin, p), (choices.index(b), -margin, 1 - p)):
            wins[:, k] += m > 0
            sums[:, k] += np.clip(m, -20, 20)
            sure[:, k] = np.minimum(sure[:, k], q)
    best = np.argmax(wins + 1e-4 * sums, 1)
    return best, sure[np.arange(len(x)), best]


def predict(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    families = list(model["groups"])
    f, p = _vote(families, model["between"], x)
    lang, score = np.empty(len(x), object), np.zeros(len(x))
    for i, name in enumerate(families):
        if (m := f == i).any():
            choice, q = _vote(model["groups"][name], model["within"][name], x[m])
            lang[m], score[m] = np.array(model["groups"][name], object)[choice], p[m] * q
    return lang, score


def fitted(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> dict | None:
    """Machines from rows (doc_id, text, lang) that aren't held out; None if there are none."""
    known = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out())
    x, langs = sample_vectors(sampled(known, "lang", per_language), "lang")
    return fit(x, langs) if langs else None


def has_letter(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Letters are sought in bytes first: only texts without an ASCII letter are looked at as text."""
    count = np.r_[0, np.cumsum(((buf | 32) - 97) < 26)]
    has = count[ends] > count[starts]
    for i in np.flatnonzero(~has):
        has[i] = any(c.isalpha() for c in buf[starts[i] : ends[i]].tobytes().decode("utf-8", "replace"))
    return has


def _judged(model: dict | None, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of each text."""
    has = has_letter(buf, starts, ends)
    lang, score = np.full(len(starts), "und", object), np.zeros(len(starts))
    if model is not None and has.any():
        got, s = predict(model, vectors(buf, starts, ends))
        lang[has], score[has] = got[has], s[has]
    return lang, score


def identify(docs: DataFrame, labelled: DataFrame | None = None, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score; labelled (text, lang, doc_id) is docs itself if not given."""
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs if labelled is None else labelled, per_language))

    def run(batches):
        for b in batches:
            at = 0
            for ids, buf, starts, ends in pieces(b.column("doc_id"), b.column("text"), rows=VECTOR_ROWS):
                n = len(ids)
                lang, score = _judged(model.value, buf, starts, ends)
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[at : at + n], b.column("held_out")[at : at + n], pa.array(lang.tolist(), pa.string()), pa.array(score.astype(float))], ["doc_id", "held_out", "lang_pred", "score"])
                at += n

    return text_rows(docs, held_out().alias("held_out")).mapInArrow(thrifty(run), "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, labelled: DataFrame | None = None, per_language: int = PER_LANGUAGE) -> DataFrame:
    """The rows of docs whose language is identified; those that are `und` go, each by its own text, whatever its doc_id."""
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs if labelled is None else labelled, per_language))

    def run(batches):
        for b in batches:
            known = [_judged(model.value, buf, starts, ends)[0] != "und" for _, buf, starts, ends in pieces(b.column("doc_id"), b.column("text"), rows=VECTOR_ROWS)]
            yield b.filter(pa.array(np.concatenate(known) if known else [], pa.bool_()))

    return small_batches(docs).mapInArrow(thrifty(run), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
