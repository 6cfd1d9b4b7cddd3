"""Jaccard self-join of word-shingle sets by universe partition and pigeonhole, with exact verification.

A document's set holds its distinct 5-word shingles (fewer words: the whole sequence as one; no words: none, linked with
nothing). Words are [^\\x20\\x09-\\x0D]+ after A-Z are lower-cased. Two documents link when
100 * common >= 75 * union. Sets are equal by two 64-bit hashes and compared as 64-bit shingle hashes.

Sizes fall into bands. A band's scheme deals the universe of shingles over m segments by their hash. Linked sets of x and
y shingles differ in at most (x + y) / 7 of them, so all segments but that many are equal. What a document indexes:
 - 3 to 6 shingles: the set and its one-deletion neighbours, as linked sets up to there differ in one shingle at most;
 - 6 and more: each segment that isn't empty, whole; in its own band's scheme and, if partners may be smaller, in the band
   below;
 - if too many of its segments are empty to count on that: also each single shingle, the finest partition.
At least m - (x + y) / 7 - (empty in both) segments are shared. A document may therefore leave out that many less one: by cost,
those whose key most documents have; of single shingles three quarters of them less one. The sets of a key are compared
with one of them first; keys whose sets this joins are done, and of few sets those still apart are compared. Frequent keys that
stay open, as a passage that many texts have leaves them, are replaced by the rarest shingles of their sets; only what
even these leave open, sets of which three quarters are frequent shingles, is compared in blocks of bounded size.
Before sets are moved, counts of their hashes in bins rule out pairs that differ too much.

Equal sets are one class from the start. Null text, empty text: n_shingles 0. Repeated rows: rows of equal sets.
Equal doc_ids: each row is answered. A row without doc_id is answered as well: its component_id is the smallest doc_id it
reaches, null if there is none. Very long texts: sets of any size have a band. Empty table: no rows.
"""

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundtrace.llm.features import text_rows
from fundtrace.llm.graph import components
from fundtrace.llm.store import checked_broadcast, counted, thrifty, thrifty_group, with_keys, written
from fundtrace.llm.text import LOWER, gram_hashes, mix, pieces, word_hashes, word_spans

SHINGLE = 5


class Rule(NamedTuple):
    """Words of a shingle, and the percentage of their union that linked sets share."""

    words: int
    percent: int


FIVE_WORDS = Rule(SHINGLE, 75)
#: Documents of a key that are paired among themselves; keys of more are frequent.
FEW = 8
#: Documents in a block of the comparison of frequent keys' members.
BLOCK = 512
_LOWER = np.frombuffer(LOWER, np.uint8)


def _bands() -> np.ndarray:
    edges = [6]
    while edges[-1] < 1 << 31:
        edges.append(max(edges[-1] + 1, int(np.ceil(edges[-1] * 1.6))))
    return np.array(edges, np.int64)


EDGES = _bands()
#: Most differences of a linked pair whose smaller set is in the band, and segments of the band.
MOST_DIFFER = ((EDGES[1:] - 1) + 4 * (EDGES[1:] - 1) // 3) // 7
SEGMENTS = np.ceil(1.3 * (MOST_DIFFER + 1)).astype(np.int64) + 4


def shingle_sets(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int = SHINGLE):
    """(text, hash) of the distinct shingles in order, and the number for each text."""
    low = _LOWER[buf]
    first, last, n = word_spans(low, starts, ends)
    words = word_hashes(low, first, last)
    base = np.r_[0, np.cumsum(n)[:-1]]
    grams = gram_hashes(words, k)
    long = np.maximum(n - k + 1, 0)
    of = np.repeat(np.arange(len(n)), long)
    at = np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long) + np.repeat(base, long)
    h = grams[at] if len(at) else np.zeros(0, np.uint64)
    short = np.flatnonzero((n > 0) & (n < k))
    whole = np.array([gram_hashes(words[base[i] : base[i] + n[i]], int(n[i]))[0] ^ np.uint64(n[i]) for i in short], np.uint64)
    of, h = np.r_[of, short], np.r_[h, whole]
    order = np.lexsort((h, of))
    of, h = of[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (of[1:] != of[:-1]) | (h[1:] != h[:-1])
    of, h = of[keep], h[keep]
    return of, h, np.bincount(of, minlength=len(n))


def set_ids(of: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each text's set."""
    total = np.r_[np.uint64(0), np.cumsum(mix(h))]
    end = np.cumsum(n)
    return mix(total[end] - total[end - n] + n.astype(np.uint64))


def _segments(of: np.ndarray, h: np.ndarray, m: np.ndarray, scheme: np.ndarray):
    """(text, key) of the segments that aren't empty."""
    seg = (mix(h) >> np.uint64(16)) % m[of].astype(np.uint64)
    order = np.lexsort((seg, of))
    o, s = of[order], seg[order]
    at = np.flatnonzero(np.r_[True, (o[1:] != o[:-1]) | (s[1:] != s[:-1])]) if len(o) else np.zeros(0, np.int64)
    total = np.add.reduceat(mix(h[order] + np.uint64(1)), at) if len(at) else np.zeros(0, np.uint64)
    return o[at], mix(total + mix(s[at] * np.uint64(1 << 20) + scheme[o[at]].astype(np.uint64)))


def keys_of(of: np.ndarray, h: np.ndarray, n: np.ndarray):
    """(text, key, kind) rows and the number of keys of each kind that a text may leave out.

    The kind is the parity of the scheme, 2 for single shingles, 3 for neighbourhoods.
    """
    out, spare = [], np.zeros((len(n), 3), np.int64)
    small = (n >= 3) & (n <= 6)
    sel = small[of]
    if sel.any():
        o, inner = of[sel], mix(h[sel] + np.uint64(2))
        total = np.zeros(len(n), np.uint64)
        np.add.at(total, o, inner)
        rows = np.flatnonzero(small)
        for text, key in ((rows, total[rows]), (o, total[o] - inner)):
            out.append((text, mix(key + np.uint64(2)), np.full(len(text), 3, np.uint8)))
    band = np.searchsorted(EDGES, n, "right") - 1
    differ = (n + 4 * n // 3) // 7
    unsafe = np.zeros(len(n), bool)
    for lower in (0, 1):
        scheme = band - lower
        use = (scheme >= 0) & ((lower == 0) | (3 * n < 4 * EDGES[np.maximum(band, 0)]))
        sel = use[of]
        o, key = _segments(of[sel], h[sel], SEGMENTS[np.maximum(scheme, 0)], np.maximum(scheme, 0))
        out.append((o, key, (scheme[o] & 1).astype(np.uint8)))
        free = np.bincount(o, minlength=len(n)) - differ - 1
        rows = np.flatnonzero(use)
        spare[rows, scheme[rows] & 1] = free[rows]
        unsafe |= use & (free < 0)
    sel = unsafe[of]
    out.append((of[sel], mix(h[sel] + np.uint64(3)), np.full(sel.sum(), 2, np.uint8)))
    spare[:, 2] = (3 * n + 3) // 4 - 1
    text, key, kind = (np.concatenate(x) for x in zip(*out))
    return text, key, kind, np.clip(spare, 0, 1 << 30)


def bins_of(n: np.ndarray) -> np.ndarray:
    """Number of bins in a set's sketch: a power of two near an eighth of its size."""
    return (1 << np.clip(np.ceil(np.log2(np.maximum(n, 1) / 8)), 4, 12).astype(np.int64))


def sketches(of: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, starts): counts of each set's hashes in its bins, one byte each, cut at 255."""
    bins = bins_of(n)
    start = np.r_[0, np.cumsum(bins)]
    slot = start[of] + ((h >> np.uint64(8)) & (bins[of] - 1).astype(np.uint64)).astype(np.int64)
    return np.minimum(np.bincount(slot, minlength=start[-1]), 255).astype(np.uint8), start


def may_link(x: bytes, y: bytes, nx: int, ny: int) -> bool:
    """False only if the bins show that the sets differ in more shingles than linked sets may. Cutting counts
    brings them nearer to each other, never farther apart; folding bins does the same."""
    x, y = np.frombuffer(x, np.uint8).astype(np.int64), np.frombuffer(y, np.uint8).astype(np.int64)
    if max(x.max(), y.max()) == 255 and len(x) != len(y):
        return True
    k = min(len(x), len(y))
    return 7 * np.abs(x.reshape(-1, k).sum(0) - y.reshape(-1, k).sum(0)).sum() <= nx + ny


SPARE = np.dtype([("set_id", "<i8"), ("even", "<i4"), ("odd", "<i4"), ("single", "<i4")])
#: Bytes of packed keys and sets that a bucket should hold.
BUCKET_BYTES = 16 << 20
#: Frequent keys, and sets, that a task remembers.
REMEMBERED = 1 << 20


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text and rid, a hash of the text alone: neither a missing nor a repeated doc_id matters."""
    return text_rows(docs, F.xxhash64("text").alias("rid"))


def _named(fp: np.ndarray, second: np.ndarray, alike: np.ndarray) -> np.ndarray:
    """Ids of sets: their first hash, and for those that only it takes for equal (alike, sorted) both."""
    out = fp.view(np.int64).copy()
    if len(alike):
        m = np.isin(out, alike)
        out[m] = mix(fp[m] ^ second[m]).view(np.int64)
    return out


def _described(rows: DataFrame) -> DataFrame:
    """doc_id, rid, set_id, second, n, sketch of each document; second: another hash of the set."""
    def run(batches):
        for b in batches:
            at = 0
            for ids, buf, starts, ends in pieces(b.column("rid"), b.column("text")):
                of, h, n = shingle_sets(buf, starts, ends)
                sketch, start = sketches(of, h, n)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id")[at : at + len(ids)], pa.array(ids), pa.array(set_ids(of, h, n).view(np.int64)), pa.array(set_ids(of, mix(h), n).view(np.int64)), pa.array(n.astype(np.int64)),
                     pa.array([sketch[i:j].tobytes() for i, j in zip(start, start[1:])], pa.binary())], ["doc_id", "rid", "set_id", "second", "n", "sketch"])
                at += len(ids)

    return rows.mapInArrow(thrifty(run), "doc_id long, rid long, set_id long, second long, n long, sketch binary")


def _indexed(rows: DataFrame, buckets: int, alike: np.ndarray) -> DataFrame:
    """(bucket, keys, sets, spare, many_keys, many_sets): packed keys with their sets by hash of the key.

    A task gives each set once. A key of more than FEW sets of a piece, and all that follows with it in the task,
    goes to the buckets of its sets instead (many_*), and one of these sets stands for them where the key is matched: so
    the bucket of a key that much of the corpus has doesn't follow its members.
    """
    def run(batches):
        seen, hot = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            for _, buf, starts, ends in pieces(b.column("rid"), b.column("text")):
                of, h, n = shingle_sets(buf, starts, ends)
                fp = _named(set_ids(of, h, n), set_ids(of, mix(h), n), alike)
                stands = np.zeros(len(n), bool)
                stands[np.unique(fp, return_index=True)[1]] = True
                stands &= (n > 0) & ~np.isin(fp, seen)
                seen = np.union1d(seen if len(seen) < REMEMBERED else seen[:0], fp[stands])
                keep = stands[of]
                of, h, n = of[keep], h[keep], np.where(stands, n, 0)
                text, key, kind, spare = keys_of(of, h, n)
                whole = (((key >> np.uint64(34)) % np.uint64(buckets)).astype(np.int64) << 32) | ((key.astype(np.uint32) & np.uint32(0xFFFFFFFC)) | kind).astype(np.int64)
                order = np.lexsort((fp[text], whole))
                text, whole = text[order], whole[order]
                begin = np.flatnonzero(np.r_[True, whole[1:] != whole[:-1]]) if len(whole) else np.zeros(0, np.int64)
                size = np.diff(np.r_[begin, len(whole)])
                known = np.isin(whole[begin], hot)
                hot = np.union1d(hot if len(hot) < REMEMBERED else hot[:0], whole[begin[size > FEW]])
                many = np.repeat(known | (size > FEW), size)
                left = ~many
                left[begin[~known]] = True  # the first of them stands for a key that is new
                home = ((fp.view(np.uint64) >> np.uint64(34)) % np.uint64(buckets)).astype(np.int64)
                info = np.zeros(len(n), SPARE)
                info["set_id"], info["even"], info["odd"], info["single"] = fp, *spare.T
                info, home_of = info[stands], home[stands]
                at = [whole[left] >> 32, home_of, home[text[many]]]
                used = np.unique(np.concatenate(at))
                cols = [[] for _ in range(5)]
                orders = [np.argsort(x, kind="stable") for x in at]
                packed = [((whole[left] & 0xFFFFFFFF).astype(np.uint32), fp[text[left]]), (info,), (whole[many], fp[text[many]])]
                slots = [(0, 1), (2,), (3, 4)]
                for x, o, values, into in zip(at, orders, packed, slots):
                    i, j = np.searchsorted(x[o], used), np.searchsorted(x[o], used, "right")
                    for v, c in zip(values, into):
                        v = v[o]
                        cols[c] = [v[p:q].tobytes() for p, q in zip(i.tolist(), j.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *[pa.array(c, pa.binary()) for c in cols]], ["bucket", "keys", "sets", "spare", "many_keys", "many_sets"])

    return rows.select("rid", "text").mapInArrow(thrifty(run), "bucket int, keys binary, sets binary, spare binary, many_keys binary, many_sets binary")


MATCHED = "key long, set_id long, size long, hub long, even int, odd int, single int"


def _match(df: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: the sets of each key that two have (key, set_id, size, hub), those that a task kept apart (size null), and
    of sets what they may leave out (key null)."""
    bucket = np.int64(df["bucket"].iloc[0]) << 32
    sets, keys = (np.frombuffer(b"".join(df[c]), t) for c, t in (("sets", np.int64), ("keys", np.uint32)))
    order = np.lexsort((sets, keys))
    k, s = keys[order], sets[order]
    keep = np.ones(len(k), bool)
    keep[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
    k, s = k[keep], s[keep]
    twice = np.zeros(len(k), bool)
    twice[1:] = k[1:] == k[:-1]
    twice[:-1] |= twice[1:]
    info = np.unique(np.frombuffer(b"".join(df["spare"]), SPARE))
    many, of = (np.frombuffer(b"".join(df[c]), np.int64) for c in ("many_keys", "many_sets"))
    k, s = k[twice], s[twice]
    begin = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    size = np.diff(np.r_[begin, len(k)])
    n, m = len(k), len(many)
    total = n + m + len(info)
    after = lambda *x: np.concatenate([*x, np.zeros(total - sum(map(len, x)), np.int64)])
    null = lambda first: np.arange(total) >= first
    return pd.DataFrame({
        "key": pd.arrays.IntegerArray(after(bucket | k.astype(np.int64), many), null(n + m)), "set_id": np.r_[s, of, info["set_id"]],
        "size": pd.arrays.IntegerArray(after(np.repeat(size, size)), null(n)), "hub": pd.arrays.IntegerArray(after(np.repeat(s[begin], size)), null(n)),
        **{c: np.r_[np.zeros(n + m, np.int32), info[c]] for c in ("even", "odd", "single")}})


def _unneeded_left_out(frequent: DataFrame, spare: DataFrame) -> DataFrame:
    """Frequent keys (key, set_id, size) less those that each set may leave out: its most frequent ones."""
    kept = frequent.withColumn("kind", F.expr("CAST(key & 3 AS INT)"))
    counts = kept.groupBy("set_id").agg(*[F.count_if(F.col("kind") == k).alias(f"n{k}") for k in range(4)])
    # Most sets may leave out all of their frequent keys; only the others are ranked.
    needs = counts.join(spare, "set_id").filter("n0 > even OR n1 > odd OR n2 > single OR n3 > 0").select("set_id", "even", "odd", "single")
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("rank"), F.col("key").alias("key"))))
    out = F.max(F.expr("CASE kind WHEN 0 THEN even WHEN 1 THEN odd WHEN 2 THEN single ELSE 0 END"))
    lists = kept.join(needs, "set_id").groupBy("set_id", "kind").agg(ordered.alias("keys"), out.alias("out"))
    return lists.select("set_id", F.explode(F.slice("keys", F.col("out") + 1, F.size("keys"))).alias("k")).select("set_id", F.col("k.key").alias("key"))


def _near(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets that their sizes and sketches don't rule out."""
    def run(batches):
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("x", "y", "na", "nb")]
            m = pa.array([may_link(*r) for r in zip(*cols)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(m), b.column("b").filter(m)], ["a", "b"])

    side = lambda k, n, x: known.select(F.col("set_id").alias(k), F.col("n").alias(n), F.col("sketch").alias(x))
    both = pairs.join(side("a", "na", "x"), "a").join(side("b", "nb", "y"), "b").filter("4 * least(na, nb) >= 3 * greatest(na, nb)")
    return both.select("a", "b", "x", "y", "na", "nb").mapInArrow(thrifty(run), "a long, b long")


def _linked(common, x, y, percent):
    return 100 * common >= percent * (x + y - common)


def confirmed(near: DataFrame, known: DataFrame, rows: DataFrame, alike: np.ndarray, rule: Rule) -> DataFrame:
    """Pairs (a, b) of sets that link, of those in near; every pair is compared by all its shingles."""
    def run(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = np.count_nonzero(np.isin(x, y, assume_unique=True, kind="sort")) if len(x) else 0
                ok.append(_linked(common, len(x), len(y), rule.percent))
            m = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(m), b.column("b").filter(m)], ["a", "b"])

    near, seen = counted(near, "near")
    if not seen["n"]:
        return near
    sets = written(_sets(rows, near.select(F.explode(F.array("a", "b")).alias("set_id")).distinct(), known, alike, rule), "sets")
    sides = near.join(sets.select(F.col("set_id").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("set_id").alias("b"), F.col("hashes").alias("y")), "b")
    return sides.select("a", "b", "x", "y").mapInArrow(thrifty(run), "a long, b long")


def settled(members: DataFrame, roots: DataFrame | None, check) -> tuple[DataFrame, DataFrame, int]:
    """Components with what links the sets of each key, and the members of frequent keys that are in different ones, and their number.

    members: key, set_id, hub, size (more than one); roots: components so far; check: pairs -> those that link. The sets of
    a key are compared with one of them, the hub. Keys that this joins are done; of the others only sets
    still apart are compared, and only while the key has few sets.
    """
    star = members.filter("set_id != hub").select(F.least("hub", "set_id").alias("a"), F.greatest("hub", "set_id").alias("b")).distinct()
    roots = components(check(star), roots)
    placed = members.join(checked_broadcast(roots.withColumnRenamed("node", "set_id")), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    apart = placed.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least < most").select("key")
    rest, seen = counted(placed.join(apart, "key"), "open", frequent=F.count_if(F.col("size") > FEW))
    few = rest.filter(F.col("size") <= FEW).filter("set_id != hub").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("set_id", "component"))).alias("m"))
    # At most FEW sets each, and none of a component with another of it.
    pairs = F.expr("flatten(transform(m, x -> transform(filter(m, y -> y.set_id > x.set_id AND y.component != x.component), y -> struct(x.set_id AS a, y.set_id AS b))))")
    roots = components(check(few.select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct()), roots)
    return roots, rest.filter(F.col("size") > FEW).select("key", "set_id", "hub", "size"), seen["frequent"]


def by_key(rows: DataFrame) -> DataFrame:
    """(key, set_id, size, hub) of the keys that several sets have; rows: distinct (key, set_id)."""
    size = rows.groupBy("key").agg(F.count("*").alias("size"), F.min("set_id").alias("hub")).filter("size > 1")
    return rows.join(size, "key").select("key", "set_id", "size", "hub")


def _rarest(members: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """(key, set_id): of each set of members as many of its rarest shingles as linked sets can't all lack.

    A set of n shingles shares at least the rule's share s of them with a linked one, so among its rarest (1 - s) n + 1, in an
    order that all sets keep, one is shared. What makes keys frequent, passages that many texts have, comes last here.
    """
    def run(batches):
        for b in batches:
            ids, hashes = b.column("set_id").to_numpy(), [np.frombuffer(x, np.int64) for x in b.column("hashes").to_pylist()]
            for i, h in zip(ids, hashes):
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(h), i))], ["key", "set_id"])

    asked = members.select("set_id").distinct()
    tokens = written(sets.join(asked, "set_id").select("set_id", "hashes").mapInArrow(thrifty(run), "key long, set_id long"), "tokens")
    size = tokens.groupBy("key").agg(F.count("*").alias("size"))
    order = F.array_sort(F.collect_list(F.struct("size", "key")))
    lists = tokens.join(size, "key").groupBy("set_id").agg(order.alias("t"))
    first = F.slice("t", 1, F.expr(f"CAST(size(t) - (size(t) * {rule.percent} + 99) div 100 + 1 AS INT)"))
    return lists.select("set_id", F.explode(F.filter(first, lambda x: x["size"] > 1)).alias("x")).select(F.col("x.key").alias("key"), "set_id")


def _block_links(df: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links between the two sides of a pair of blocks, one for each set of the left side and component of the right."""
    left, right = df[df["side"] == 0], df[df["side"] == 1]
    none = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    if not len(left) or not len(right):
        return none
    tokens = [np.frombuffer(b"".join(x["hashes"]), np.uint64) for x in (left, right)]
    rows = [np.repeat(np.arange(len(x)), x["n"].to_numpy()) for x in (left, right)]
    shared = np.intersect1d(*tokens)
    common = np.zeros((len(left), len(right)), np.float32)
    where = [np.searchsorted(shared, t) for t in tokens]
    inside = [(w < len(shared)) & (shared[np.minimum(w, len(shared) - 1)] == t) if len(shared) else np.zeros(len(t), bool) for w, t in zip(where, tokens)]
    for start in range(0, len(shared), 4096):
        parts = []
        for r, w, i, n in zip(rows, where, inside, (len(left), len(right))):
            m = i & (w >= start) & (w < start + 4096)
            part = np.zeros((n, 4096), np.float32)
            part[r[m], w[m] - start] = 1
            parts.append(part)
        common += parts[0] @ parts[1].T
    x, y = left["n"].to_numpy()[:, None], right["n"].to_numpy()[None, :]
    ok = _linked(common, x, y, percent) & (left["component"].to_numpy()[:, None] != right["component"].to_numpy()[None, :])
    i, j = np.nonzero(ok)
    found = pd.DataFrame({"a": left["set_id"].to_numpy()[i], "b": right["set_id"].to_numpy()[j], "of": right["component"].to_numpy()[j]})
    return found.drop_duplicates(["a", "of"])[["a", "b"]]


def _families(members: DataFrame, now: DataFrame, block: int) -> DataFrame:
    """(family, main, blocks, set_id, component, block): the sets of frequent keys that other components of their family than theirs have, dealt over blocks.

    members: key, set_id; now: components so far. Members joined by any key form a family, main is the largest component of it.
    """
    hub = members.groupBy("key").agg(F.min("set_id").alias("hub"))
    family = components(members.join(hub, "key").select(F.col("hub").alias("a"), F.col("set_id").alias("b")).distinct())
    own = family.select(F.col("node").alias("set_id"), F.col("component").alias("family")).join(now.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    size = own.groupBy("family", "component").count()
    largest = size.groupBy("family").agg(F.max_by("component", F.struct("count", "component")).alias("main"), F.count("*").alias("parts"), F.sum("count").alias("members")).filter("parts > 1")
    # A family has few rows here besides its number of members: a salt tells its blocks apart.
    member = own.join(checked_broadcast(largest), "family").withColumn("blocks", F.ceil(F.col("members") / block).cast("int"))
    return member.withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))


def _block_sides(member: DataFrame, *columns: str) -> DataFrame:
    """Both sides of each pair of blocks: sets outside of main, and all of the family."""
    out = member.filter("component != main")
    left = out.select("family", "set_id", "component", *columns, F.col("block").alias("lb"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("rb"), F.lit(0).alias("side"))
    # The right side goes only to blocks that hold sets to be compared.
    asked = out.select("family", F.col("block").alias("lb")).distinct()
    right = member.select("family", "set_id", "component", *columns, F.col("block").alias("rb"), F.lit(1).alias("side")).join(asked, "family").select(*left.columns)
    return left.unionByName(right)


def _block_pairs(members: DataFrame, now: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among the sets of frequent keys, compared in blocks; members: key, set_id; now: components so far.

    Sets of a family's largest component are told from the others, and only these are compared, with all of the family, block by block.
    """
    member = written(_families(members, now, BLOCK).join(sets, "set_id"), "members")
    return _block_sides(member, "n", "hashes").groupBy("family", "lb", "rb").applyInPandas(thrifty_group(lambda df: _block_links(df, percent)), "a long, b long")


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, null if none has one), a row for each of docs."""
    spark, rows = docs.sparkSession, _rows(docs)
    info = written(_described(rows), "described")
    info, alike = told_apart(info)
    known = written(info.filter("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.min("rid").alias("rid"), F.max("n").alias("n"), F.first("sketch").alias("sketch"), F.count("*").alias("copies")), "known")
    total = known.agg(F.sum("n")).head()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 12 * total // BUCKET_BYTES, 8)
    matched = written(_indexed(rows, buckets, alike).groupBy("bucket").applyInPandas(thrifty_group(_match), MATCHED), "matched")
    spare = matched.filter("key IS NULL").select("set_id", "even", "odd", "single").distinct()
    # Keys that a task kept apart have members in many buckets; all others are complete.
    apart = matched.filter("key IS NOT NULL AND size IS NULL").select("key", "set_id")
    there = matched.filter("size IS NOT NULL").select("key", "set_id", "size", "hub")
    keys = checked_broadcast(written(apart.select("key").distinct(), "apart"))
    whole = there.join(keys, "key", "left_anti")
    scattered = by_key(there.join(keys, "key", "left_semi").select("key", "set_id").union(apart).distinct())
    members = written(whole.unionByName(scattered.select(*whole.columns)), "members")
    kept = by_key(_unneeded_left_out(members.filter(F.col("size") > FEW), spare).select("key", "set_id"))
    members = written(members.filter(F.col("size") <= FEW).unionByName(kept), "kept")

    check = lambda pairs: confirmed(_near(pairs, known), known, rows, alike, FIVE_WORDS)
    return labelled(info, known, finished(*settled(members, None, check), check, known, rows, alike, FIVE_WORDS))


def told_apart(info: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """info with another set_id for sets that one hash alone takes for equal, and these hashes: of N sets about N ** 2 / 2 ** 65, one of 6 billion."""
    alike = info.filter("n > 0").groupBy("set_id").agg(F.min("second").alias("p"), F.max("second").alias("q")).filter("p != q").select("set_id")
    alike = np.sort(np.array([r.set_id for r in alike.collect()], np.int64))
    if len(alike):
        info = info.mapInArrow(lambda batches: (b.set_column(b.schema.get_field_index("set_id"), "set_id", pa.array(_named(b.column("set_id").to_numpy().view(np.uint64), b.column("second").to_numpy().view(np.uint64), alike))) for b in batches), info.schema)
    return info, alike


def finished(roots: DataFrame, rest: DataFrame, n: int, check, known: DataFrame, rows: DataFrame, alike: np.ndarray, rule: Rule, in_blocks=_block_pairs) -> DataFrame:
    """Components once the n members (rest) of frequent keys that are still apart have been compared by their rarest shingles, or in blocks."""
    if n:
        sets = written(_sets(rows, rest.select("set_id").distinct(), known, alike, rule), "sets")
        roots, rest, n = settled(written(by_key(_rarest(rest, sets, rule)), "rarest"), roots, check)
        if n:
            roots = components(in_blocks(rest.select("key", "set_id"), roots, sets, rule.percent), roots)
    return roots


def labelled(info: DataFrame, known: DataFrame, roots: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of info."""
    roots = roots.select(F.col("node").alias("set_id"), "component")
    placed = known.select("set_id", "doc_id", "copies").join(checked_broadcast(roots), "set_id", "left").withColumn("root", F.coalesce("component", "set_id"))
    # Of sets with neither links nor copies each document is its own component.
    smallest = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.sum("copies").alias("k")).filter("k > 1")
    classes = placed.join(smallest, "root").select("set_id", "component_id")
    joined = info.select("doc_id", "set_id", "n").join(checked_broadcast(classes), (info["set_id"] == classes["set_id"]) & (info["n"] > 0), "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("component_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


FILTER_BITS = 24


def _sets(rows: DataFrame, wanted: DataFrame, known: DataFrame, alike: np.ndarray, rule: Rule) -> DataFrame:
    """(set_id, n, hashes) of the wanted sets, from one document of each; its text is found by the text's own hash."""
    one, seen = counted(wanted.join(known.select("set_id", "rid"), "set_id"), "wanted")

    def run(batches):
        for b in batches:
            for _, buf, starts, ends in pieces(b.column("rid"), b.column("text")):
                of, h, n = shingle_sets(buf, starts, ends, rule.words)
                fp = _named(set_ids(of, h, n), set_ids(of, mix(h), n), alike)
                cut = np.r_[0, np.cumsum(n)]
                first = np.unique(fp, return_index=True)[1]
                yield pa.RecordBatch.from_arrays([pa.array(fp[first]), pa.array(n[first].astype(np.int64)), pa.array([h[cut[i] : cut[i + 1]].tobytes() for i in first], pa.binary())], ["set_id", "n", "hashes"])

    found = with_keys(rows.select("rid", "text"), one, seen["n"], "rid", FILTER_BITS, run, "set_id long, n long, hashes binary")
    return found.join(one.select("set_id"), "set_id").groupBy("set_id").agg(F.first("n").alias("n"), F.first("hashes").alias("hashes"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


def _sql() -> str:
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({lower}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)),
e2 AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT e2.b, r.root FROM r JOIN e2 ON r.doc_id = e2.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(root) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.doc_id = d.doc_id GROUP BY ALL
"""


SQL = _sql()
