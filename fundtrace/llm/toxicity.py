"""Toxicity by two class-conditional Kneser-Ney models, compared by their length-normalised log-likelihoods.

Texts are lower-cased (A-Z); bytes that are neither letters nor parts of other characters become spaces. Each class has counts of words, by
documents, from its labelled documents, discounted as modified Kneser-Ney does (a discount each for counts of 1, 2 and more, from the
counts of counts). What is taken off goes to a back-off that both classes share: the word as bytes, by continuation counts of 3, 2
and 1 bytes gathered from all documents (the number of different bytes before a gram), mixed with an equal share for
each known word. As it is shared, a rare expression says little for either side.

A word's evidence is the difference of its two log-likelihoods; words of neither class have none. A document's difference is the sum over its
informative words, those whose evidence is at least a threshold in size, normalised by their number (and one), so that neither long ordinary
text around an expression nor repeated words move it. The threshold, one of THRESHOLDS, and a logistic curve are fitted on labelled
documents that the counts don't hold; then these are counted too. Labels are learned only where crc32(doc_id) mod 5 isn't 0, from at most about PER_CLASS
documents of either class (a bounded sample by a hash of doc_id); the back-off counts take every document.

A null text is an empty one; texts of any length are taken whole. Equal texts have equal scores, repeated rows are answered each; of labels that
differ for a doc_id the toxic one counts. Words are told apart by a 64-bit hash. Without labels of both classes every score is 0. An
empty table gives no rows. Other columns of the tables, whatever their names, aren't read.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundtrace.llm.features import held_out, sampled, text_rows
from fundtrace.llm.store import thrifty
from fundtrace.llm.text import pieces, word_hashes

PER_CLASS = 12_000
DISCOUNT = 0.75
#: Different grams that a task holds before it hands them on.
HELD = 1 << 20
#: Share of the bytes in the back-off; the rest is shared equally among words.
BY_BYTES = 0.5
#: Least size of evidence that counts, one of which is chosen on labelled documents.
THRESHOLDS = (1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 5.0)

_CLEAN = np.frombuffer(bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)), np.uint8)


def _slot(x: np.ndarray, bits: int) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return (x >> np.uint64(64 - bits)).astype(np.int64)


class Grams:
    """Values of different grams, looked up by the gram itself: its slot only tells where to look."""

    def __init__(self, code: np.ndarray, value: np.ndarray):
        self.bits = max(8, (2 * len(code)).bit_length())
        slot = _slot(code, self.bits)
        order = np.argsort(slot, kind="stable")
        self.code, self.value = code[order].astype(np.uint64), value[order].astype(np.float32)
        self.first = np.r_[0, np.cumsum(np.bincount(slot, minlength=1 << self.bits))].astype(np.int32)

    def at(self, code: np.ndarray) -> np.ndarray:
        """0 for grams that aren't there."""
        out = np.zeros(len(code), np.float32)
        s = _slot(code, self.bits)
        i, end = self.first[s], self.first[s + 1]
        todo = np.flatnonzero(i < end)
        i, end = i[todo], end[todo]
        while len(todo):
            hit = self.code[i] == code[todo]
            out[todo[hit]] = self.value[i[hit]]
            more = ~hit & (i + 1 < end)
            todo, i, end = todo[more], i[more] + 1, end[more]
        return out


def _codes(clean: np.ndarray, n: int) -> np.ndarray:
    m = max(0, len(clean) - n + 1)
    x = np.zeros(m, np.uint64)
    for j in range(n):
        x = (x << np.uint64(8)) | clean[j : j + m]
    return x


def _separate(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Clean bytes with runs of spaces as one and a space before and behind each text; starts of the texts in them."""
    n = len(starts)
    out = np.full(len(buf) + n + 1, 32, np.uint8)
    out[np.arange(len(buf)) + np.repeat(np.arange(n), ends - starts) + 1] = _CLEAN[buf]
    keep = np.r_[True, (out[1:] != 32) | (out[:-1] != 32)]
    place = np.cumsum(keep) - 1
    # A text begins at the space before it, which may be the one behind the text before.
    return out[keep], place[starts + np.arange(n)]


def _inside(first: np.ndarray, m: int, n: int) -> np.ndarray:
    """Which of m grams of n bytes lie in one text; first: see _separate."""
    out = np.ones(m, bool)
    for k in range(1, n - 1):
        at = first - k
        out[at[(at >= 0) & (at < m)]] = False
    return out


def shared_counts(docs: DataFrame) -> DataFrame:
    """(gram, n): 3-byte grams of all documents and the number of different bytes before each."""
    def run(batches):
        def part():
            return pa.RecordBatch.from_arrays([pa.array(held.astype(np.int64))], ["code"])

        held = np.zeros(0, np.uint32)
        for b in batches:
            for _, buf, starts, ends in pieces(b.column("doc_id"), b.column("text")):
                clean, first = _separate(buf, starts, ends)
                x = _codes(clean, 4)
                held = np.unique(np.r_[held, x[_inside(first, len(x), 4)].astype(np.uint32)])
                if len(held) > HELD:
                    yield part()
                    held = held[:0]
        yield part()

    every = text_rows(docs).mapInArrow(thrifty(run), "code long").distinct()
    return every.groupBy(F.expr("code & 16777215").alias("gram")).agg(F.count("*").alias("n"))


def _words(clean: np.ndarray, first: np.ndarray):
    """Words of clean bytes (see _separate): first bytes, hashes, and the text of each."""
    edge = clean == 32
    start = np.flatnonzero(~edge & np.r_[True, edge[:-1]])
    end = np.flatnonzero(edge & np.r_[False, ~edge[:-1]])
    return start, word_hashes(clean, start, end), np.searchsorted(first, start, "right") - 1


def byte_logs(clean: np.ndarray, start: np.ndarray, triples: np.ndarray, n3: np.ndarray) -> np.ndarray:
    """Log-likelihood of each word and the space behind it as bytes, wherever it stands. triples, n3: see interpolated."""
    if not len(start):
        return np.zeros(0)
    code = np.r_[0, _codes(np.r_[np.uint8(32), clean], 3)].astype(np.int64)
    code[start] = 0x202000 + clean[start].astype(np.int64)
    return np.add.reduceat(np.log(interpolated(triples, n3, code)), start)


def class_counts(rows: DataFrame, shared) -> DataFrame:
    """(code, t, o, bytes): words by their hash, the numbers of toxic and of ordinary documents that have them, and their byte_logs.
    shared: broadcast of sorted 3-byte grams and their continuation counts."""
    def run(batches):
        for b in batches:
            label = b.column("toxic").to_numpy()
            at = 0
            for ids, buf, starts, ends in pieces(b.column("doc_id"), b.column("text")):
                clean, first = _separate(buf, starts, ends)
                start, code, of = _words(clean, first)
                mine = label[at : at + len(ids)][of]
                at += len(ids)
                order = np.lexsort((code, of))
                code, of, mine, logs = code[order], of[order], mine[order], byte_logs(clean, start, *shared.value)[order]
                once = np.ones(len(code), bool)
                once[1:] = (code[1:] != code[:-1]) | (of[1:] != of[:-1])
                known, where, inverse = np.unique(code[once], return_index=True, return_inverse=True)
                t = np.bincount(inverse, mine[once], len(known)).astype(np.int64)
                n = np.bincount(inverse, minlength=len(known))
                yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), pa.array(t), pa.array(n - t), pa.array(logs[once][where])], ["code", "t", "o", "bytes"])

    counted = rows.mapInArrow(thrifty(run), "code long, t long, o long, bytes double")
    return counted.groupBy("code").agg(F.sum("t").alias("t"), F.sum("o").alias("o"), F.max("bytes").alias("bytes"))


def continuation(codes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """P(last byte | two bytes before) of the wanted 3-byte codes, from distinct 4-byte codes."""
    return interpolated(*np.unique(codes & 0xFFFFFF, return_counts=True), wanted)


def interpolated(triples: np.ndarray, n3: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """P(last byte | two bytes before) of the wanted 3-byte codes, from sorted 3-byte codes and their continuation counts.

    A gram counts by the number of different bytes before it; what a context lacks is interpolated from the shorter one.
    """
    pairs, n2 = np.unique(triples & 0xFFFF, return_counts=True)
    single = np.bincount(pairs & 0xFF, minlength=256)

    def level(grams, n, asked, lower):
        if not len(grams):
            return lower
        context, of = np.unique(grams >> 8, return_inverse=True)
        total, kinds = np.bincount(of, n), np.bincount(of)
        i = np.minimum(np.searchsorted(context, asked >> 8), len(context) - 1)
        j = np.minimum(np.searchsorted(grams, asked), len(grams) - 1)
        count = np.where(grams[j] == asked, n[j], 0)
        return np.where(context[i] == asked >> 8, (np.maximum(count - DISCOUNT, 0) + DISCOUNT * kinds[i] * lower) / total[i], lower)

    p1 = (single + 0.5) / (single.sum() + 128)
    p2 = level(pairs, n2, wanted & 0xFFFF, p1[wanted & 0xFF])
    return level(triples, n3, wanted, p2)


def discounts(n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts of 0, 1, 2 and more, from the counts of counts."""
    c1, c2, c3, c4 = (max(int((n == k).sum()), 1) for k in (1, 2, 3, 4))
    y = c1 / (c1 + 2 * c2)
    return np.r_[0, np.clip([1 - 2 * y * c2 / c1, 2 - 3 * y * c3 / c2, 3 - 4 * y * c4 / c3], 0.1, [0.95, 1.9, 2.85])]


def likelihoods(n: np.ndarray, base: np.ndarray) -> np.ndarray:
    """P(word | class) by counts n of the class; base: P(word) of the shared back-off."""
    off = discounts(n)[np.minimum(n, 3)]
    return (n - off + off.sum() * base) / n.sum()


def log_ratios(toxic: np.ndarray, ordinary: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """log P(word | toxic) - log P(word | ordinary); logs: byte_logs of the words."""
    base = BY_BYTES * np.exp(logs) + (1 - BY_BYTES) / len(logs)
    return np.log(likelihoods(toxic, base)) - np.log(likelihoods(ordinary, base))


def evidence(table: Grams, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Per text: the normalised difference for each of THRESHOLDS, that over all words, and the largest word's evidence."""
    clean, first = _separate(buf, starts, ends)
    n = len(starts)
    _, code, of = _words(clean, first)
    d = table.at(code).astype(np.float64)
    columns = []
    for least in THRESHOLDS:
        m = np.abs(d) >= least
        columns.append(np.bincount(of[m], d[m], n) / (1 + np.bincount(of[m], minlength=n)))
    largest = np.full(n, -np.inf)
    np.maximum.at(largest, of, d)
    return np.column_stack([*columns, np.bincount(of, d, n) / np.maximum(np.bincount(of, minlength=n), 1), np.where(np.isfinite(largest), largest, 0)])


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on one feature by Newton's method with a small penalty: weights and mean log loss."""
    x, w = np.column_stack([np.ones(len(x)), x]), np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + 0.1 * w
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        w = w - np.linalg.solve(h, g)
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-9, 1 - 1e-9)
    return w, float(-np.mean(np.where(y == 1, np.log(p), np.log(1 - p))))


def _table(counts: pd.DataFrame) -> Grams:
    ratios = log_ratios(*(counts[c].to_numpy() for c in ("t", "o", "bytes")))
    return Grams(counts["code"].to_numpy(np.int64).view(np.uint64), ratios)


def score(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted, difference (that the score comes from), and for information per_word_difference (over all
    words) and word_evidence (of the most toxic word); labels: doc_id, toxic (0 or 1)."""
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # At most about 2 * per_class ids; two thirds of the documents are counted, the others set threshold and curve.
    some = sampled(known, "toxic", per_class).withColumn("curve", F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(3)) == 0)
    texts = text_rows(docs).join(F.broadcast(some), "doc_id")
    # However large the corpus, there are at most 2 ** 24 grams of 3 bytes.
    every = shared_counts(docs).toPandas().sort_values("gram")
    shared = spark.sparkContext.broadcast((every["gram"].to_numpy(np.int64), every["n"].to_numpy(np.int64)))
    part = lambda rule: class_counts(texts.filter(rule).select("doc_id", "text", "toxic"), shared).toPandas()
    counts = part("NOT curve")
    table, chosen, curve = spark.sparkContext.broadcast(Grams(np.zeros(0, np.int64), np.zeros(0))), 0, None
    if counts["t"].sum() and counts["o"].sum():
        table = spark.sparkContext.broadcast(_table(counts))
        names = [f"e{i}" for i in range(len(THRESHOLDS))]

        def measure(batches):
            for b in batches:
                at = 0
                for ids, buf, starts, ends in pieces(b.column("doc_id"), b.column("text")):
                    e = evidence(table.value, buf, starts, ends)
                    yield pa.RecordBatch.from_arrays([b.column("toxic")[at : at + len(ids)], *[pa.array(c) for c in e.T[: len(names)]]], ["toxic", *names])
                    at += len(ids)

        held = texts.filter("curve").select("doc_id", "text", "toxic").mapInArrow(thrifty(measure), "toxic int, " + ", ".join(f"{c} double" for c in names)).toPandas()
        if held["toxic"].nunique() > 1:
            fits = [fit_curve(held[c].to_numpy(), held["toxic"].to_numpy()) for c in names]
            chosen = int(np.argmin([loss for _, loss in fits]))
            curve = fits[chosen][0]
        # With threshold and curve fixed, the documents that set them are counted too.
        every = pd.concat([counts, part("curve")]).groupby("code", as_index=False).agg({"t": "sum", "o": "sum", "bytes": "max"})
        table = spark.sparkContext.broadcast(_table(every))

    def run(batches):
        for b in batches:
            at = 0
            for ids, buf, starts, ends in pieces(b.column("doc_id"), b.column("text")):
                n = len(ids)
                e = evidence(table.value, buf, starts, ends)
                p = np.zeros(n) if curve is None else 1 / (1 + np.exp(-np.clip(curve[0] + curve[1] * e[:, chosen], -30, 30)))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id")[at : at + n], b.column("held_out")[at : at + n], pa.array(p), pa.array((p >= 0.5).astype(np.int32)), *[pa.array(np.ascontiguousarray(e[:, c])) for c in (chosen, -2, -1)]],
                    ["doc_id", "held_out", "score", "predicted", "difference", "per_word_difference", "word_evidence"])
                at += n

    return text_rows(docs, held_out().alias("held_out")).mapInArrow(thrifty(run), "doc_id long, held_out boolean, score double, predicted int, difference double, per_word_difference double, word_evidence double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
