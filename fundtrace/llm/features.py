"""Hashed byte n-grams of whole texts, bounded samples of labelled rows, and the ids that are held out."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundtrace.llm.store import checked_broadcast, small_batches, thrifty, written
from fundtrace.llm.text import LOWER, pieces, word_hashes, word_spans

_LOWER = np.frombuffer(LOWER, np.uint8)
BITS = 12
#: Texts whose vectors a task holds at a time.
VECTOR_ROWS = 128


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5, is 0; a null id isn't held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


#: Rows of a sample in all: with many values each gets fewer, but at least FEWEST.
MOST_ROWS, FEWEST = 24_000, 8


def sampled(rows: DataFrame, by: str, most: int) -> DataFrame:
    """About `most` rows of each value of `by`, chosen by a hash of doc_id; all rows of a rare value. `by` isn't null.

    Every value is in the sample, however many there are; of more than MOST_ROWS / most values each has less than `most` rows, and
    of more than MOST_ROWS / FEWEST, as no set of languages or grades has, FEWEST.
    """
    counts = written(rows.groupBy(by).count(), "values")
    share = max(FEWEST, min(most, MOST_ROWS // max(1, counts.count())))
    rates = counts.select(by, F.least(F.lit(1.0), F.lit(share) / F.col("count")).alias("rate"))
    number = F.pmod(F.xxhash64(F.lit(71), "doc_id"), F.lit(1_000_000))
    return rows.join(checked_broadcast(rates), by).filter(number < F.col("rate") * 1_000_000).select(*rows.columns)


def vectors(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A row of 2 ** BITS square roots of hashed 1- to 3-gram counts for each text, scaled to length 1."""
    n = len(starts)
    low = (_LOWER[buf] if lower else buf).astype(np.uint32)
    of = np.repeat(np.arange(n, dtype=np.int32) << BITS, ends - starts)
    counts = np.zeros(n << BITS, np.float32)
    x = np.zeros(len(low), np.uint32)
    for size in (1, 2, 3):
        m = len(low) - size + 1
        if m <= 0:
            break
        x = (x[:m] << np.uint32(8)) ^ low[size - 1 :]
        h = (x + np.uint32(size)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        key = of[:m] + (h >> np.uint32(32 - BITS)).astype(np.int32)
        if n > 1:
            key = key[of[:m] == of[size - 1 :]]
        counts += np.bincount(key, minlength=n << BITS)
    v = np.sqrt(counts, out=counts).reshape(n, 1 << BITS)
    v /= np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v))[:, None], 1e-9)
    return v


def repeat_share(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Share of each text's words that equal the word before."""
    first, last, n = word_spans(buf, starts, ends)
    words, of = word_hashes(buf, first, last), np.repeat(np.arange(len(n)), n)
    same = (words[1:] == words[:-1]) & (of[1:] == of[:-1])
    return np.bincount(of[1:][same], minlength=len(n)) / np.maximum(n, 1)


def sample_vectors(docs: DataFrame, target: str, make=vectors) -> tuple[np.ndarray, list]:
    """Vectors and targets of a bounded sample of documents, on the driver, in order of doc_id."""
    def run(batches):
        for b in batches:
            at = 0
            for ids, buf, starts, ends in pieces(b.column("doc_id"), b.column("text"), rows=VECTOR_ROWS):
                v = make(buf, starts, ends).astype(np.float16)
                yield pa.RecordBatch.from_arrays([pa.array(ids), b.column(target)[at : at + len(ids)], pa.array([x.tobytes() for x in v], pa.binary())], ["doc_id", target, "v"])
                at += len(ids)

    cols = docs.select("doc_id", "text", target)
    rows = cols.mapInArrow(thrifty(run), f"doc_id long, {target} {dict(cols.dtypes)[target]}, v binary").toArrow()
    if not len(rows):
        return np.zeros((0, 1 << BITS), np.float32), []
    order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")
    out, at = None, 0
    for chunk in rows.column("v").chunks:
        for v in chunk:
            got = np.frombuffer(v.as_buffer(), np.float16)
            out = np.empty((len(rows), len(got)), np.float32) if out is None else out
            out[at] = got
            at += 1
    return out[order], rows.column(target).take(order).to_pylist()


def text_rows(docs: DataFrame, *more: str) -> DataFrame:
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
