"""Removal of passages that repeat, by matching statistics over compressed full-text indexes.

Words are [^\\x20\\x09-\\x0D]+, unchanged. Every word goes that is covered by a window of 35 words whose words also start
anywhere else, in the same document or another.

Windows are dealt to shards by their smallest 11-word gram (by hash), so equal windows meet in one shard and consecutive
windows with the same gram travel as one segment. A gram that occurs once, as nearly all do, can't have repeated windows, and
its segments aren't moved. A gram whose segments are all the same repeats them whole. A gram in very many different contexts would fill one shard; its windows are dealt by their
own hash instead, and only those that occur twice. A shard indexes its distinct segments, weighted by how often each occurs: suffix array, Burrows-Wheeler
transform in a wavelet matrix of packed bits, and longest common prefixes. All its segments are streamed against it by
backward search, which gives at each word the longest match that occurs twice or more; a window is repeated where this
reaches 35.

Null text: no words, the hash of nothing. Repeated rows repeat each other's windows and lose them all. Equal doc_ids with
different texts are told apart. Empty table: no rows.
"""

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundtrace.llm.features import text_rows
from fundtrace.llm.store import hash_bit_set, held, thrifty, thrifty_group, written
from fundtrace.llm.text import gram_hashes, mix, pieces, powers, window_min, word_hashes, word_spans

WINDOW = 35
GRAM = 11
PLACES = 28
FILTER_BITS = 25
#: Different segments with one gram from which on its windows are dealt by their own hash.
CROWDED = 300
#: Segments in a shard.
SHARD = 3000


def segments(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(words, base, text, start, windows, gram): consecutive windows with one smallest gram; start counts words of the text."""
    first, last, n = word_spans(buf, starts, ends)
    words = word_hashes(buf, first, last)
    base = np.r_[0, np.cumsum(n)[:-1]]
    none = np.zeros(0, np.int64)
    if len(words) < WINDOW:
        return words, base, none, none, none, none.view(np.uint64)
    grams = gram_hashes(words, GRAM)
    low = np.uint64((1 << PLACES) - 1)
    least = window_min((grams & ~low) | np.arange(len(grams), dtype=np.uint64), WINDOW - GRAM + 1)
    place = (least & low).astype(np.int64)
    inside = np.maximum(n - WINDOW + 1, 0)
    of = np.repeat(np.arange(len(n)), inside)
    at = np.arange(inside.sum()) - np.repeat(np.cumsum(inside) - inside, inside) + np.repeat(base, inside)
    if not len(at):
        return words, base, none, none, none, none.view(np.uint64)
    p = place[at]
    cut = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (of[1:] != of[:-1])])
    count = np.diff(np.r_[cut, len(at)])
    # The smallest hashes are alike in their upper bits: scrambled again they spread over slots and shards.
    return words, base, of[cut], at[cut] - base[of[cut]], count, mix(grams[p[cut]])


#: Bytes of text that are cut into windows at a time: each byte takes some 60 of arrays meanwhile.
PIECE = 1 << 18


def spans_hash(words: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hash of words[start : start + length] for each pair."""
    factor = 0xA24BAED4963EE407 | 1
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(factor, len(words)), out=total[1:])
    back = powers(pow(factor, -1, 1 << 64), len(words) + 1)
    return mix((total[start + length] - total[start]) * back[start] + length.astype(np.uint64))


def _gram_counts(rows: DataFrame) -> DataFrame:
    """(gram, total, kinds): occurrences and different segments of grams that occur twice or more."""
    def run(batches):
        for b in batches:
            for _, buf, starts, ends in pieces(b.column("rid"), b.column("text"), PIECE):
                words, base, of, start, count, gram = segments(buf, starts, ends)
                content = spans_hash(words, base[of] + start, count + WINDOW - 1)
                order = np.lexsort((content, gram))
                g, c = gram[order], content[order]
                cut = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (c[1:] != c[:-1])]) if len(g) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(g[cut].view(np.int64)), pa.array(c[cut].view(np.int64)), pa.array(np.diff(np.r_[cut, len(g)]))], ["gram", "content", "n"])

    kinds = rows.mapInArrow(thrifty(run), "gram long, content long, n long").groupBy("gram", "content").agg(F.sum("n").alias("n"))
    return kinds.groupBy("gram").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).filter("total > 1")


def _parts(buf, starts, ends, repeated: np.ndarray, crowded: np.ndarray):
    """(words, base, text, start, windows, gram, alone): segments whose gram may be repeated; those of a crowded gram
    are given as single windows, with alone set."""
    words, base, of, start, count, gram = segments(buf, starts, ends)
    m = held(repeated, gram, FILTER_BITS)
    of, start, count, gram = of[m], start[m], count[m], gram[m]
    many = held(crowded, gram, FILTER_BITS - 4)
    times = np.where(many, count, 1)
    row = np.repeat(np.arange(len(of)), times)
    start = start[row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
    return words, base, of[row], start, np.where(many, 1, count)[row], gram[row], many[row]


def _crowded_windows(rows: DataFrame, repeated: np.ndarray, crowded: np.ndarray) -> DataFrame:
    """(content): hashes of the windows with crowded grams that occur twice or more; the others needn't be moved."""
    known = rows.sparkSession.sparkContext.broadcast((repeated, crowded))

    def run(batches):
        for b in batches:
            for _, buf, starts, ends in pieces(b.column("rid"), b.column("text"), PIECE):
                words, base, of, start, count, _, alone = _parts(buf, starts, ends, *known.value)
                content, n = np.unique(spans_hash(words, (base[of] + start)[alone], (count + WINDOW - 1)[alone]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(content.view(np.int64)), pa.array(n)], ["content", "n"])

    return rows.mapInArrow(thrifty(run), "content long, n long").groupBy("content").agg(F.sum("n").alias("n")).filter("n > 1").select("content")


def _moved(rows: DataFrame, repeated: np.ndarray, crowded: np.ndarray, again: np.ndarray) -> DataFrame:
    """(rid, start, windows, key, content): segments whose gram may be repeated, without their words."""
    known = rows.sparkSession.sparkContext.broadcast((repeated, crowded, again))

    def run(batches):
        repeated, crowded, again = known.value
        for b in batches:
            for ids, buf, starts, ends in pieces(b.column("rid"), b.column("text"), PIECE):
                words, base, of, start, count, gram, alone = _parts(buf, starts, ends, repeated, crowded)
                content = spans_hash(words, base[of] + start, count + WINDOW - 1)
                m = ~alone | held(again, content, FILTER_BITS)
                # A window dealt singly is known by two hashes, as all others are by their gram and content.
                key = np.where(alone, spans_hash(mix(words), base[of] + start, count + WINDOW - 1) if alone.any() else content, gram)[m]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[of[m]]), pa.array(start[m].astype(np.int32)), pa.array(count[m].astype(np.int32)), pa.array(key.view(np.int64)), pa.array(content[m].view(np.int64))],
                    ["rid", "start", "windows", "key", "content"])

    return rows.mapInArrow(thrifty(run), "rid long, start int, windows int, key long, content long")


def _contents(rows: DataFrame, varied: np.ndarray, crowded: np.ndarray) -> DataFrame:
    """(key, content, words) of segments whose gram has several contents; a task gives each content once."""
    known = rows.sparkSession.sparkContext.broadcast((varied, crowded))

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            for _, buf, starts, ends in pieces(b.column("rid"), b.column("text"), PIECE):
                words, base, of, start, count, gram, alone = _parts(buf, starts, ends, *known.value)
                of, start, count, gram = of[~alone], start[~alone], count[~alone], gram[~alone]
                content = spans_hash(words, base[of] + start, count + WINDOW - 1)
                first = [i for i, c in enumerate(content.tolist()) if not (c in seen or seen.add(c))]
                texts = [words[i : i + n].tobytes() for i, n in zip((base[of] + start)[first].tolist(), (count + WINDOW - 1)[first].tolist())]
                if len(seen) > 1_000_000:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(gram[first].view(np.int64)), pa.array(content[first].view(np.int64)), pa.array(texts, pa.binary())], ["key", "content", "words"])

    return rows.mapInArrow(thrifty(run), "key long, content long, words binary")


class WaveletMatrix:
    """Ranks of symbols in a sequence, level by level from the highest bit; bits packed in words with counts before each."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.n, self.levels = len(symbols), []
        now = symbols.astype(np.int64)
        for bit in range(max(1, int(size - 1).bit_length()) - 1, -1, -1):
            ones = (now >> bit) & 1 == 1
            padded = np.zeros((self.n // 64 + 1) * 64, bool)
            padded[: self.n] = ones
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            before = np.r_[0, np.cumsum(np.bitwise_count(packed).astype(np.int64))]
            zeros = self.n - int(ones.sum())
            self.levels.append((bit, packed, before, zeros))
            now = np.concatenate([now[~ones], now[ones]])
        self.base = self._go(np.arange(size), np.zeros(size, np.int64))

    def _go(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for bit, packed, before, zeros in self.levels:
            word = i >> 6
            ones = before[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))).astype(np.int64)
            i = np.where((symbol >> bit) & 1 == 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before place i."""
        return self._go(symbol, i) - self.base[symbol]


class ShardIndex:
    """FM-index of weighted segments; matches of up to DEPTH words."""

    DEPTH = 64

    def __init__(self, parts: list[np.ndarray], weights: np.ndarray):
        lengths = np.array([len(p) for p in parts])
        self.words, ids = np.unique(np.concatenate(parts), return_inverse=True)
        n = int(lengths.sum()) + len(parts)
        self.begin = np.cumsum(lengths + 1) - lengths - 1
        text = np.zeros(n, np.int64)  # 0 ends a segment
        inside = np.ones(n, bool)
        inside[self.begin + lengths] = False
        text[inside] = ids + 1
        self.text, self.lengths, self.n = text, lengths, n
        # Suffixes in order of their first DEPTH symbols, by doubling.
        rank, ranks, h = text.copy(), [text.copy()], 1
        while h < self.DEPTH:
            ahead = np.zeros(n, np.int64)
            ahead[:-h or None] = rank[h:] + 1 if h < n else 0
            pair = rank * (n + 2) + ahead
            order = np.argsort(pair, kind="stable")
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.r_[0, pair[order][1:] != pair[order][:-1]])
            ranks.append(rank)
            h *= 2
        sa = order
        size = len(self.words) + 1
        self.bwt = WaveletMatrix(text[sa - 1], size)
        self.before = np.r_[0, np.cumsum(np.bincount(text, minlength=size))][:-1]
        self.weight = np.r_[0, np.cumsum(np.repeat(weights, lengths + 1)[sa])]
        # Longest common prefixes of neighbours, by the ranks of halves.
        a, b, lcp = sa[:-1].copy(), sa[1:].copy(), np.zeros(n - 1, np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            ok = (a < n) & (b < n)
            same = np.zeros(n - 1, bool)
            same[ok] = ranks[k][a[ok]] == ranks[k][b[ok]]
            step = same * (1 << k)
            lcp, a, b = lcp + step, a + step, b + step
        self.lcp = np.r_[-1, np.minimum(lcp, 120), -1].astype(np.int8)
        self.least = [self.lcp]
        while 2 << (len(self.least) - 1) <= n:
            half = 1 << (len(self.least) - 1)
            self.least.append(np.minimum(self.least[-1][:-half], self.least[-1][half:]))

    def _wider(self, lo: np.ndarray, hi: np.ndarray):
        """The next wider interval, and how many words its suffixes share."""
        d = np.maximum(self.lcp[lo], self.lcp[hi])
        for k in range(len(self.least) - 1, -1, -1):
            table, step = self.least[k], 1 << k
            i = lo - step + 1
            lo = np.where((i >= 0) & (table[np.clip(i, 0, len(table) - 1)] >= d), lo - step, lo)
            hi = np.where((hi < len(table)) & (table[np.minimum(hi, len(table) - 1)] >= d), hi + step, hi)
        return lo, hi, np.maximum(d, 0).astype(np.int64)

    def statistics(self) -> np.ndarray:
        """At each place of the text, the longest match (within its segment) that has a weight of 2 or more."""
        out = np.zeros(self.n, np.int64)
        q = len(self.lengths)
        lo, hi, size = np.zeros(q, np.int64), np.full(q, self.n, np.int64), np.zeros(q, np.int64)
        for back in range(1, int(self.lengths.max()) + 1):
            live = np.flatnonzero(self.lengths >= back)
            at = self.begin[live] + self.lengths[live] - back
            symbol = self.text[at]
            todo = np.arange(len(live))
            while len(todo):
                s, i = symbol[todo], live[todo]
                both = self.before[np.r_[s, s]] + self.bwt.rank(np.r_[s, s], np.r_[lo[i], hi[i]])
                l2, h2 = both[: len(s)], both[len(s) :]
                ok = self.weight[h2] - self.weight[l2] >= 2
                lo[i[ok]], hi[i[ok]], size[i[ok]] = l2[ok], h2[ok], size[i[ok]] + 1
                failed = todo[~ok]
                i = live[failed]
                root = (lo[i] == 0) & (hi[i] == self.n)
                wide = i[~root]
                if len(wide):
                    lo[wide], hi[wide], size[wide] = self._wider(lo[wide], hi[wide])
                    # A root interval shares nothing.
                    size[wide[(lo[wide] == 0) & (hi[wide] == self.n)]] = 0
                todo = failed[~root]
            out[at] = size[live]
        return out


RESULT = "key long, content long, mask long"


def _shard(counts: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
    rows = counts.merge(texts[["key", "content", "words"]], on=["key", "content"])
    if not len(rows):
        return pd.DataFrame({"key": np.zeros(0, np.int64), "content": np.zeros(0, np.int64), "mask": np.zeros(0, np.int64)})
    index = ShardIndex([np.frombuffer(w, np.uint64) for w in rows["words"]], rows["n"].to_numpy())
    reach = index.statistics() >= WINDOW
    windows = rows["windows"].to_numpy(np.int64)
    row = np.repeat(np.arange(len(rows)), windows)
    k = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    mask = np.zeros(len(rows), np.int64)
    np.bitwise_or.at(mask, row, np.where(reach[index.begin[row] + k], np.int64(1) << k, 0))
    return pd.DataFrame({"key": rows["key"], "content": rows["content"], "mask": mask})


def repeated(docs: DataFrame) -> DataFrame:
    """(rid, places): for each document with repeated windows, their first words as (start, mask) pairs; rid: see _rows."""
    rows = _rows(docs)
    grams = written(_gram_counts(rows), "grams")
    twice = hash_bit_set(grams, "gram", FILTER_BITS)
    crowded = hash_bit_set(grams.filter(F.col("kinds") > CROWDED), "gram", FILTER_BITS - 4)
    again = hash_bit_set(_crowded_windows(rows, twice, crowded), "content", FILTER_BITS) if crowded.any() else np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    varied = hash_bit_set(grams.filter("kinds > 1"), "gram", FILTER_BITS)
    moved = written(_moved(rows, twice, crowded, again), "segments")
    kinds = moved.groupBy("key", "content").agg(F.count("*").alias("n"), F.first("windows").alias("windows"))
    several = kinds.groupBy("key").agg(F.count("*").alias("contents"), F.sum("n").alias("total")).filter("total > 1")
    kinds = written(kinds.join(several.select("key", "contents"), "key"), "kinds")
    # A gram with one content: the whole segment is repeated, and all its windows. Others are searched.
    plain = kinds.filter("contents = 1").select("key", "content", F.expr("shiftleft(1L, windows) - 1").alias("mask"))
    searched = kinds.filter("contents > 1")
    shards = max(1, -(-searched.count() // SHARD))
    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard")
    counts = searched.select(shard, "key", "content", "n", "windows")
    # A task gives a content once; of all tasks' the shard gets one.
    texts = _contents(rows, varied, crowded).dropDuplicates(["key", "content"]).select(shard, "key", "content", "words")
    found = counts.groupBy("shard").cogroup(texts.groupBy("shard")).applyInPandas(thrifty_group(_shard), RESULT)
    masks = written(found.filter("mask != 0").union(plain), "masks")
    return moved.select("rid", "start", "key", "content").join(masks, ["key", "content"]).groupBy("rid").agg(F.collect_set(F.struct("start", "mask")).alias("places"))


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text and rid, which only equal rows share."""
    d = text_rows(docs)
    return d.withColumn("rid", F.xxhash64("doc_id", "text"))


def _kept(words: list[bytes], places) -> list[bytes]:
    cover = np.zeros(len(words) + 1, np.int64)
    start, mask = np.array([p["start"] for p in places], np.int64), np.array([p["mask"] for p in places], np.int64)
    of, k = np.nonzero((mask[:, None] >> np.arange(WINDOW - GRAM + 1)) & 1)
    first = np.unique(start[of] + k)
    cover[first] += 1
    cover[first + WINDOW] -= 1
    gone = np.cumsum(cover)[:-1] > 0
    return [w for w, g in zip(words, gone.tolist()) if not g]


OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def dedup(docs: DataFrame, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and with texts kept: the words that stay, joined by one space."""
    rows = _rows(docs)
    places = written(repeated(docs), "places")
    bits = docs.sparkSession.sparkContext.broadcast(hash_bit_set(places, "rid", FILTER_BITS - 1))

    def result(ids, kept, n):
        joined = [b" ".join(k) for k in kept]
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(n, pa.int64()), pa.array([a - len(k) for a, k in zip(n, kept)], pa.int64()), pa.array([hashlib.sha256(j).hexdigest() for j in joined], pa.string()),
             pa.array([j.decode("utf-8", "replace") for j in joined], pa.string()) if texts else pa.nulls(len(n), pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    def split(b):
        return [(t or "").encode("utf-8", "surrogatepass").split() for t in b.column("text").to_pylist()]

    def whole(batches):
        for b in batches:
            b = b.filter(pa.array(~held(bits.value, b.column("rid").to_numpy().view(np.uint64), FILTER_BITS - 1)))
            for i in range(0, len(b), 1024):
                words = split(part := b.slice(i, 1024))
                yield result(part.column("doc_id"), words, [len(w) for w in words])

    def asked(batches):
        for b in batches:
            yield b.filter(pa.array(held(bits.value, b.column("rid").to_numpy().view(np.uint64), FILTER_BITS - 1)))

    def cut(batches):
        for b in batches:
            for i in range(0, len(b), 1024):
                words = split(part := b.slice(i, 1024))
                kept = [w if p is None else _kept(w, p) for w, p in zip(words, part.column("places").to_pylist())]
                yield result(part.column("doc_id"), kept, [len(w) for w in words])

    # A broadcast of places would put both functions, and so two Python workers, into each task.
    touched = rows.mapInArrow(thrifty(asked), rows.schema).join(places.hint("merge"), "rid", "left").select("doc_id", "text", "places")
    return rows.mapInArrow(thrifty(whole), OUT).union(touched.mapInArrow(thrifty(cut), OUT))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS s FROM (SELECT *, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY s) AS c FROM win) WHERE c > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM rep),
lists AS (SELECT doc_id, list(p) AS gone FROM gone GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM words ANTI JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p GROUP BY words.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
