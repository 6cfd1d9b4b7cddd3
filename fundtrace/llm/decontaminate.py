"""Benchmark decontamination with one Aho-Corasick automaton over the benchmark's word windows.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z are lower-cased. A window is 13 consecutive words of an item;
an item of fewer words, but not none, is one window. A document word inside any occurrence of a window is hit.

Null and empty texts have no words; empty items never occur; repeated items and windows count for each item. Windows of
items without an id hit words like all others, but name no item. Long texts are scanned whole. Every row of documents is answered by itself, in however
many rounds, and whether its doc_id is null or repeated.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundtrace.llm.store import thrifty

WINDOW = 13
#: Windows for one automaton, and their size: characters, and ITEM for each item that has one. A benchmark with more is scanned in
#: rounds, so no task holds more. Measured: an automaton takes 48 MB per million characters, so about 290 MB at most.
MAX_WINDOWS = 400_000
MAX_SIZE = 6_000_000
ITEM = 2
#: A document is contaminated if at least one word in so many is hit.
ONE_IN = 20

_MAP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
RESULT = "doc_id long, row long, n_words long, spans array<int>, items array<string>"


def normalised(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(_MAP).split()


def windows(benchmark: DataFrame) -> DataFrame:
    """(window, items): each distinct window with the ids of the items that have it, sorted as strings."""
    def cut(batches):
        for b in batches:
            ids, out = b.column("item_id").to_pylist(), ([], [])
            for i, t in zip(ids, b.column("text").to_pylist()):
                w = normalised(t)
                for j in range(max(1, len(w) - WINDOW + 1) if w else 0):
                    out[0].append(b" ".join(w[j : j + WINDOW]).decode("utf-8", "surrogatepass"))
                    out[1].append(i)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string())], ["window", "item"])

    cols = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    return cols.mapInArrow(thrifty(cut), "window string, item string").groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _scan(docs: DataFrame, found: list, after=None, schema: str = RESULT) -> DataFrame:
    """found: (window, items) rows, within MAX_WINDOWS and MAX_SIZE. Gives row (a hash of the text), n_words, hit word spans and items of each document,
    or what after, a function of these batches, makes of them in the same Python worker."""
    held = docs.sparkSession.sparkContext.broadcast([(r.window, list(r.items)) for r in found])

    def run(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for w, items in held.value:
            automaton.add_word(f" {w} ", (w.count(" ") + 1, items))
        ready = len(held.value) > 0
        if ready:
            automaton.make_automaton()
        for b in batches:
            n, spans, items = [], [], []
            for t in b.column("text").to_pylist():
                words = normalised(t)
                n.append(len(words))
                hit, names = [], set()
                if ready and words:
                    line = (b" " + b" ".join(words) + b" ").decode("utf-8", "surrogatepass")
                    at = None
                    for end, (length, of) in automaton.iter(line):
                        if at is None:  # places of the spaces: word k ends at space k + 1
                            at = np.flatnonzero(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32) == 32)
                        k = int(np.searchsorted(at, end))
                        hit.append((k - length, k))
                        names.update(of)
                spans.append([x for s in sorted(set(hit)) for x in s])
                items.append(sorted(names))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("row"), pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], ["doc_id", "row", "n_words", "spans", "items"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("row", F.xxhash64("text", F.isnull("text"))).mapInArrow(thrifty((lambda batches: after(run(batches))) if after else run), schema)


def covered(spans) -> int:
    total, until = 0, 0
    for a, b in sorted(zip(spans[::2], spans[1::2])):
        total += max(0, b - max(a, until))
        until = max(until, b)
    return total


def matches(docs: DataFrame, benchmark: DataFrame, max_windows: int = MAX_WINDOWS, max_size: int = MAX_SIZE, after=None, schema: str = "") -> DataFrame:
    """One row per document: doc_id, n_words, spans (from, to word places in turn), items (ids as sorted strings).

    With after, a function of batches of these columns, the rows that it makes of them (schema); it never has a Python worker beside the scan's.
    """
    w = windows(benchmark).persist()
    n, size = w.agg(F.count("*"), F.coalesce(F.sum(F.length("window") + 2 + ITEM * F.size("items")), F.lit(0))).first()
    rounds = max(1, -(-n // max_windows), -(-size // max_size))
    if rounds == 1:
        found = w.collect()
        w.unpersist()
        return _scan(docs, found, after, schema) if after else _scan(docs, found).drop("row")
    # A third more rounds than that, as a hash doesn't deal windows evenly.
    rounds += -(-rounds // 3)
    parts = [_scan(docs, w.filter(F.pmod(F.xxhash64("window"), F.lit(rounds)) == i).collect()) for i in range(rounds)]
    w.unpersist()
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    # Equal rows have equal answers in each round: these are put together once and given as often as the row is there.
    rows = whole.groupBy("doc_id", "row").agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_set("spans")).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.expr(f"count(*) div {len(parts)}").alias("times"))
    rows = rows.withColumn("time", F.explode(F.sequence(F.lit(1), "times"))).select("doc_id", "n_words", "spans", "items")
    return rows.mapInArrow(thrifty(after), schema) if after else rows


def decontaminate(docs: DataFrame, benchmark: DataFrame, max_windows: int = MAX_WINDOWS, max_size: int = MAX_SIZE) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, items."""
    def digest(batches):
        for b in batches:
            spans = [[x for s in sorted(zip(s[::2], s[1::2])) for x in s] for s in b.column("spans").to_pylist()]
            hits = [covered(s) for s in spans]
            items = b.column("items").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("n_words"), pa.array(hits, pa.int64()), pa.array([len(i) for i in items], pa.int64()),
                 pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in items]),
                 pa.array([h > 0 and ONE_IN * h >= n for h, n in zip(hits, b.column("n_words").to_pylist())], pa.bool_()), pa.array(spans, pa.list_(pa.int32())), b.column("items")],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "items"])

    return matches(docs, benchmark, max_windows, max_size, digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<int>, items array<string>")


CONTRACT = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def query(spark, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*CONTRACT)


_WORDS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format('text')}, []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format('text')} AS w FROM benchmark),
win AS (SELECT item, least(len(w), {WINDOW}) AS n, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS s
        FROM (SELECT *, unnest(range(1, greatest(len(w) - {WINDOW - 2}, 2))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
       FROM (SELECT d.*, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, win.n, item FROM dw JOIN win ON dw.s = win.s AND dw.n = win.n),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""
