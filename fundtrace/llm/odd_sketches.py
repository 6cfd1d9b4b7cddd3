"""Near-duplicates by MinHash: bands of samples propose pairs, odd sketches estimate them, full sets confirm them.

A document's set holds its distinct 2-word shingles (fewer words: the whole sequence as one; no words: none, linked with nothing); words are
[^\\x20\\x09-\\x0D]+ after A-Z are lower-cased. Two documents link when 100 * common >= 80 * union.

Of each set BANDS * ROWS MinHash samples are taken. ROWS of them make a band's key: a pair at similarity 0.8 shares no key with probability
(1 - 0.8 ** ROWS) ** BANDS, 7e-8, and a pair above with less. All samples, each with its number, are folded into a bitmap of SKETCH_BITS
parities, the odd sketch. The exclusive or of two sketches is the sketch of the samples in which they differ, so its population count
estimates the similarity, best where it is high; a pair is ruled out if its estimate is six standard deviations below 0.8. What is left is confirmed by
all shingles. The sets of a key are compared with one of them first, in the first bands, so in later ones only keys whose sets aren't
linked yet matter; large groups that stay open after all bands go on by their rarest shingles, as in the Jaccard join, and at last by
comparing their sketches in blocks: no bucket is capped.

Equal sets are one class from the start. Nulls and empty texts: n_shingles 0. Repeated rows and rows of one doc_id are answered each; a row without
doc_id has the smallest doc_id it reaches as component, null if there is none, and isn't kept. Texts of any length are taken whole. An
empty table gives no rows. Other columns are ignored.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundtrace.llm.features import text_rows
from fundtrace.llm.jaccard import Rule, _block_sides, _families, confirmed, finished, labelled, set_ids, settled, shingle_sets, told_apart
from fundtrace.llm.store import checked_broadcast, counted, thrifty, thrifty_group, with_keys, written
from fundtrace.llm.text import mix, pieces

TWO_WORDS = Rule(2, 80)
ROWS, BANDS, FIRST_BANDS = 6, 54, 14
SAMPLES = ROWS * BANDS
SKETCH_BITS = 512
#: Sets of which a task remembers that it has given their keys.
REMEMBERED = 1 << 20
_rng = np.random.Generator(np.random.PCG64(41))
_FACTORS = _rng.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _most_parities(percent: int) -> int:
    """Differing parities up to which a pair may be similar enough: their expected number at the threshold and six standard deviations."""
    share = 1 - percent / 100
    differ = 2 * SAMPLES * share
    stay = (1 - 2 / SKETCH_BITS) ** differ
    spread = np.sqrt(SKETCH_BITS / 4 * (1 - stay**2) + (stay * 2 * np.sqrt(SAMPLES * share * (1 - share))) ** 2)
    return int(np.ceil(SKETCH_BITS * (1 - stay) / 2 + 6 * spread))


def estimate(parities: np.ndarray) -> np.ndarray:
    """Similarity by the number of parities in which two odd sketches differ; 0 where they tell nothing."""
    return np.maximum(0, 1 + SKETCH_BITS / (4 * SAMPLES) * np.log(np.maximum(1 - 2 * parities / SKETCH_BITS, 1e-9)))


def samples(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A row of SAMPLES MinHash samples (32 bits of the least scrambled hash) for each set; h: their hashes in order, n: their sizes, not 0."""
    out, at = np.empty((SAMPLES, len(n)), np.uint32), np.cumsum(n) - n
    if len(n):
        for i, factor in enumerate(_FACTORS):
            out[i] = np.minimum.reduceat(h * factor, at) >> np.uint64(32)
    return out.T


def odd_sketches(sampled: np.ndarray) -> np.ndarray:
    """Bitmaps, of SKETCH_BITS // 8 bytes a row: a bit says whether an odd number of the set's samples fell on it."""
    m = len(sampled)
    slot = mix(sampled.astype(np.uint64) | (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32))[None, :]) % np.uint64(SKETCH_BITS)
    odd = np.bincount((np.arange(m)[:, None] * SKETCH_BITS + slot.astype(np.int64)).ravel(), minlength=m * SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(m, SKETCH_BITS), axis=1)


def band_keys(sampled: np.ndarray) -> np.ndarray:
    """A key for each band and row."""
    bands = sampled.reshape(len(sampled), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), bands.shape[:2]).copy()
    for j in range(ROWS):
        key = mix(key * np.uint64(0xD1342543DE82EF95) + bands[:, :, j] + np.uint64(1))
    return key


def _described(rows: DataFrame) -> DataFrame:
    """doc_id, rid, set_id, second, n of each row; sketch and keys (packed) where a task meets a set for the first time."""
    def run(batches):
        seen = np.zeros(0, np.int64)
        for b in batches:
            at = 0
            for ids, buf, starts, ends in pieces(b.column("rid"), b.column("text")):
                of, h, n = shingle_sets(buf, starts, ends, TWO_WORDS.words)
                fp, second = set_ids(of, h, n).view(np.int64), set_ids(of, mix(h), n).view(np.int64)
                # What two sets share in one hash but not in the other mustn't hide a set.
                name = fp ^ (second << 1)
                new = np.zeros(len(n), bool)
                new[np.unique(name, return_index=True)[1]] = True
                new &= (n > 0) & ~np.isin(name, seen)
                seen = np.union1d(seen if len(seen) < REMEMBERED else seen[:0], name[new])
                sampled = samples(h[new[of]], n[new])
                packed = [None] * len(n), [None] * len(n)
                for i, s, k in zip(np.flatnonzero(new).tolist(), odd_sketches(sampled), band_keys(sampled)):
                    packed[0][i], packed[1][i] = s.tobytes(), k.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id")[at : at + len(ids)], pa.array(ids), pa.array(fp), pa.array(second), pa.array(n.astype(np.int64)), *[pa.array(x, pa.binary()) for x in packed]],
                    ["doc_id", "rid", "set_id", "second", "n", "sketch", "keys"])
                at += len(ids)

    return rows.mapInArrow(thrifty(run), "doc_id long, rid long, set_id long, second long, n long, sketch binary, keys binary")


FILTER_BITS = 24


def _members(known: DataFrame, first: int, last: int) -> DataFrame:
    """(key, set_id, size, hub) of the keys of these bands that several sets have. Most keys have one set, so only the others' rows are joined."""
    def run(batches):
        for b in batches:
            keys = np.frombuffer(b"".join(b.column("keys").to_pylist()), np.int64).reshape(-1, BANDS)[:, first:last]
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(b.column("set_id").to_numpy(), last - first))], ["key", "set_id"])

    rows = written(known.select("set_id", "keys").mapInArrow(thrifty(run), "key long, set_id long"), "bands")
    shared, seen = counted(rows.groupBy("key").agg(F.count("*").alias("size"), F.min("set_id").alias("hub")).filter("size > 1"), "shared")
    return with_keys(rows, shared, seen["n"], "key", FILTER_BITS, lambda batches: batches, "key long, set_id long").join(shared, "key").select("key", "set_id", "size", "hub")


def _apart(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of keys whose sets aren't all in one component."""
    placed = members.join(checked_broadcast(roots.withColumnRenamed("node", "set_id")), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    open_keys = placed.groupBy("key").agg(F.min("component").alias("p"), F.max("component").alias("q")).filter("p < q").select("key")
    return members.join(open_keys, "key", "left_semi")


def _near(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that neither their sizes nor their odd sketches rule out."""
    most = _most_parities(percent)

    def run(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint64).reshape(-1, SKETCH_BITS // 64) for c in ("x", "y"))
            m = pa.array(np.bitwise_count(x ^ y).sum(1) <= most)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(m), b.column("b").filter(m)], ["a", "b"])

    side = lambda k, n, x: known.select(F.col("set_id").alias(k), F.col("n").alias(n), F.col("sketch").alias(x))
    both = pairs.join(side("a", "na", "x"), "a").join(side("b", "nb", "y"), "b").filter(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    return both.select("a", "b", "x", "y").mapInArrow(thrifty(run), "a long, b long")


#: Sets in a block; pairs of sketches that are compared at a time, pairs whose sets are, and shingles in a bitmap of these.
BLOCK, AT_ONCE, COMPARED, TOKENS = 4096, 1 << 18, 1 << 20, 1 << 14


def _bitmaps(row: np.ndarray, token: np.ndarray, n: int) -> np.ndarray:
    """A bitmap of TOKENS bits for each of n sets; row, token: their shingles' numbers, in order."""
    out, slot = np.zeros(n * TOKENS // 64, np.uint64), row * (TOKENS // 64) + (token >> 6)
    at = np.flatnonzero(np.diff(slot, prepend=-1))
    if len(at):
        out[slot[at]] = np.bitwise_or.reduceat(np.uint64(1) << (token & 63).astype(np.uint64), at)
    return out.reshape(n, TOKENS // 64)


def _common(sides: list, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Shingles that set i of the left side and set j of the right one share; sides: (hashes, row of each, number of sets)."""
    shared, out = np.intersect1d(sides[0][0], sides[1][0]), np.zeros(len(i), np.int64)
    where = []
    for h, row, n in sides:
        at = np.minimum(np.searchsorted(shared, h), max(0, len(shared) - 1))
        there = shared[at] == h if len(shared) else np.zeros(len(h), bool)
        where.append((row[there], at[there], n))
    for start in range(0, len(shared), TOKENS):
        x, y = (_bitmaps(row[m], at[m] - start, n) for row, at, n in where for m in [(at >= start) & (at < start + TOKENS)])
        for k in range(0, len(i), 2048):
            s = slice(k, k + 2048)
            out[s] += np.bitwise_count(x[i[s]] & y[j[s]]).sum(1, dtype=np.int64)
    return out


def _block_links(df: pd.DataFrame, percent: int, most: int) -> pd.DataFrame:
    """Links between the two sides of a pair of blocks, one for each set of the left side and component of the right.

    What sizes and odd sketches don't rule out is compared by all shingles, as bitmaps over those that both sides have.
    """
    halves = [df[df["side"] == k] for k in (0, 1)]
    (a, p, na), (b, q, nb) = ([x[c].to_numpy(np.int64) for c in ("set_id", "component", "n")] for x in halves)
    x, y = (np.ascontiguousarray(np.frombuffer(b"".join(z["sketch"]), np.uint64).reshape(-1, SKETCH_BITS // 64).T) for z in halves)
    sides = [(np.frombuffer(b"".join(z["hashes"]), np.uint64), np.repeat(np.arange(len(z)), z["n"].to_numpy(np.int64)), len(z)) for z in halves]
    found, open_pairs, held = [np.zeros((0, 3), np.int64)], [], 0

    def compared():
        i, j = (np.concatenate(z) for z in zip(*open_pairs))
        common = _common(sides, i, j)
        ok = 100 * common >= percent * (na[i] + nb[j] - common)
        found.append(np.column_stack([a[i], b[j], q[j]])[ok])

    step = max(1, AT_ONCE // max(1, len(b)))
    for k in range(0, len(a) if len(b) else 0, step):
        s = slice(k, k + step)
        differ = np.zeros((len(a[s]), len(b)), np.uint16)
        for v, w in zip(x, y):
            differ += np.bitwise_count(v[s, None] ^ w[None, :])
        i, j = np.nonzero(differ <= most)
        i += k
        ok = (p[i] != q[j]) & (100 * np.minimum(na[i], nb[j]) >= percent * np.maximum(na[i], nb[j]))
        open_pairs.append((i[ok], j[ok]))
        held += int(ok.sum())
        if held >= COMPARED:
            compared()
            open_pairs, held = [], 0
    if held:
        compared()
    links = pd.DataFrame(np.concatenate(found), columns=["a", "b", "of"])
    return links.drop_duplicates(["a", "of"])[["a", "b"]]


def _block_pairs(members: DataFrame, now: DataFrame, sets: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """As the Jaccard join's: links among the sets of frequent keys, compared in blocks. Sketches rule most pairs out, so blocks are larger and sets move less often."""
    most = _most_parities(percent)
    member = written(_families(members, now, BLOCK).join(sets, "set_id").join(known.select("set_id", "sketch"), "set_id"), "members")
    sides = _block_sides(member, "n", "sketch", "hashes").groupBy("family", "lb", "rb")
    return sides.applyInPandas(thrifty_group(lambda df: _block_links(df, percent, most)), "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept (doc_id is that), a row for each of docs."""
    rows = text_rows(docs, F.xxhash64("text").alias("rid"))
    info, alike = told_apart(written(_described(rows), "described"))
    known = written(info.filter("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.min("rid").alias("rid"), F.max("n").alias("n"), F.first("sketch", True).alias("sketch"), F.first("keys", True).alias("keys"), F.count("*").alias("copies")), "known")
    check = lambda pairs: confirmed(_near(pairs, known, TWO_WORDS.percent), known, rows, alike, TWO_WORDS)
    in_blocks = lambda members, now, sets, percent: _block_pairs(members, now, sets, known, percent)
    roots, rest, n = settled(written(_members(known, 0, FIRST_BANDS), "members"), None, check)
    roots, more, m = settled(written(_apart(_members(known, FIRST_BANDS, BANDS), roots), "members"), roots, check)
    # What the first bands leave open waits for the others: all of it is gone on with once.
    roots = finished(roots, rest.unionByName(more), n + m, check, known, rows, alike, TWO_WORDS, in_blocks)
    return labelled(info, known, roots).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id", "kept")


def _sql() -> str:
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({lower}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 1], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
e2 AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT e2.b, r.root FROM r JOIN e2 ON r.doc_id = e2.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(root) AS component_id, bool_and(root >= d.doc_id) AS kept FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.doc_id = d.doc_id GROUP BY ALL
"""


SQL = _sql()
