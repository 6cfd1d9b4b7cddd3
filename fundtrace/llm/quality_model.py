"""Quality by ordinal regression: one weight vector over hashed text, and ordered thresholds between the grades.

P(grade <= k) = logistic(threshold[k] - w . x). The grade of a labelled document is 0 for low quality, 1 for good quality
that is toxic, 2 for good quality that isn't. Fitted on at most about PER_GRADE documents of each grade (a bounded sample
by a hash of doc_id) that aren't held out. A text is kept if it more likely than not has grade 1 or more.

A null text is an empty one. Without labelled rows the grades are equally likely. Equal texts get equal results.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundtrace.llm.features import BITS, VECTOR_ROWS, held_out, repeat_share, sample_vectors, sampled, text_rows, vectors
from fundtrace.llm.store import thrifty
from fundtrace.llm.text import pieces

PER_GRADE = 2000
GRADES = 3


def text_vectors(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashed n-grams of the text as it is, and behind them a column for what they don't tell: how many words repeat the one before."""
    return 4 * np.column_stack([vectors(buf, starts, ends, lower=False), repeat_share(buf, starts, ends).astype(np.float32)])


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, grades: int = GRADES, penalty: float = 1e-3, steps: int = 400, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """(w, thresholds) by Adam on the mean log-likelihood; thresholds are a first one and positive steps."""
    w, t = np.zeros(x.shape[1]), np.r_[-1.0, np.zeros(grades - 2)]
    share = 1 / (np.bincount(y, minlength=grades)[y] * grades)
    p = np.concatenate([w, t])
    m, v = np.zeros_like(p), np.zeros_like(p)
    d = x.shape[1]
    for i in range(1, steps + 1):
        cuts = np.cumsum(np.r_[p[d], np.exp(p[d + 1 :])])
        s = x @ p[:d].astype(np.float32)
        upper = np.where(y < grades - 1, _sigmoid(np.r_[cuts, 0][y] - s), 1.0)
        lower = np.where(y > 0, _sigmoid(np.r_[0, cuts][y] - s), 0.0)
        like = np.maximum(upper - lower, 1e-9)
        gu, gl = upper * (1 - upper) / like * share, lower * (1 - lower) / like * share
        of_cut = np.bincount(y, gu, grades)[: grades - 1] - np.bincount(y, gl, grades)[1:]
        later = np.cumsum(of_cut[::-1])[::-1]
        g = np.concatenate([-(x.T @ (gu - gl).astype(np.float32)), [later[0]], later[1:] * np.exp(p[d + 1 :])])
        g = -g
        g[:d] += penalty * p[:d] / d
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    return p[:d], np.cumsum(np.r_[p[d], np.exp(p[d + 1 :])])


def tails(w: np.ndarray, cuts: np.ndarray, x: np.ndarray) -> np.ndarray:
    """P(grade >= k) for k = 1, 2, ... of each row."""
    return _sigmoid((x @ w.astype(np.float32))[:, None] - cuts[None, :])


def grade(docs: DataFrame, ratings: DataFrame, per_grade: int = PER_GRADE) -> DataFrame:
    """doc_id, held_out, expected_grade, p_ge_1, p_ge_2, kept; ratings: doc_id, grade (0 to GRADES - 1)."""
    rated = ratings.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("grade").cast("int").alias("grade")).filter(f"doc_id IS NOT NULL AND grade BETWEEN 0 AND {GRADES - 1}").filter(~held_out())
    some = sampled(rated.groupBy("doc_id").agg(F.min("grade").alias("grade")), "grade", per_grade)
    # At most about GRADES * per_grade ids.
    x, y = sample_vectors(text_rows(docs).join(F.broadcast(some), "doc_id"), "grade", text_vectors)
    if len(set(y)) > 1:
        w, cuts = fit(x, np.array(y, np.int64))
    else:
        w, cuts = np.zeros((1 << BITS) + 1), np.log([0.5, 2.0])
    model = docs.sparkSession.sparkContext.broadcast((w, cuts))

    def run(batches):
        w, cuts = model.value
        for b in batches:
            at = 0
            for ids, buf, starts, ends in pieces(b.column("doc_id"), b.column("text"), rows=VECTOR_ROWS):
                n = len(ids)
                p = tails(w, cuts, text_vectors(buf, starts, ends))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id")[at : at + n], b.column("held_out")[at : at + n], pa.array(p.sum(1)), pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(p[:, 0] >= 0.5)],
                    ["doc_id", "held_out", "expected_grade", "p_ge_1", "p_ge_2", "kept"])
                at += n

    return text_rows(docs, held_out().alias("held_out")).mapInArrow(thrifty(run), "doc_id long, held_out boolean, expected_grade double, p_ge_1 double, p_ge_2 double, kept boolean")


def ratings(labels: DataFrame) -> DataFrame:
    return labels.filter("quality IS NOT NULL").select("doc_id", F.expr("CASE WHEN quality = 0 THEN 0 WHEN coalesce(toxic, 0) = 1 THEN 1 ELSE 2 END").alias("grade"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grade(spark.read.parquet(f"{sf_dir}/documents.parquet"), ratings(spark.read.parquet(f"{sf_dir}/labels.parquet")))
