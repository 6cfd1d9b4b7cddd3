"""Phrases whose words stand together more often than apart, per language, counted in HAT-tries.

Texts are lower-cased (A-Z) and split at [.,;:!?\\x0A-\\x0D] into pieces, these into words [^\\x20\\x09]+. A phrase is 2 to 5
consecutive words of a piece; f is the number of its occurrences, overlaps included. Phrases of k words are counted only where
both their parts of k - 1 words are frequent, as f of a phrase is at most f of its parts: the parts' hashes go to
tasks as a bit set, in several rounds over slices of them if they are many, and what passes by chance falls by its count.

A task counts in a HAT-trie: a shallow trie over the numbers of a phrase's language and first two words leads to containers hashed by
the whole phrase. A container that grows too large bursts between two first words, or two second words where the first is the same.
Beyond a number of entries whole subtrees are spilled as runs sorted by their words, the largest first. Spark deals the runs by
(language, first two words) and adds them up there. Pairs of frequent words are many, and most are rare: their runs are first
spilled as packed hashes, merged by prefix, and only pairs whose hash is frequent are counted by their text. Within a task words and phrases are told apart by 64-bit hashes, across tasks by their text.

Nulls: a null text is empty, a null lang is `und`. Empty texts have no words. Repeated rows count again. Ties in score go by a,
then by the phrase's bytes, so ranks are definite. A text of any length is counted whole. An empty table gives no rows. Other columns are
ignored whatever their names.
"""

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fundtrace.llm.store import checked_broadcast, counted, hash_bit_set, held, small_batches, thrifty, thrifty_group, written
from fundtrace.llm.text import LOWER, gram_hashes, mix, pieces, word_hashes, word_spans

LONGEST, LEAST = 5, 100
_LOWER = np.frombuffer(LOWER, np.uint8)
_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_APART = _BREAK.copy()
_APART[list(b" \t")] = True
#: Bits of a word's number within a task.
WORD_BITS = 20
_WORD = np.uint64((1 << WORD_BITS) - 1)
#: Languages that a task numbers at a time, besides those of a batch.
MOST_LANGS = 1 << 20
#: Bytes of words that a task knows at a time.
MOST_NAME_BYTES = 32 << 20
#: Parts of phrases whose hashes one filter holds; of more there are several rounds over the documents.
ROUND_KEYS = 1 << 23


class HatTrie:
    """Counts of phrases. A row has `path` (numbers of language and first two words), `rest` (of the other words) and `gram` (hash of all).

    The containers are kept in order of their paths' lower bounds; a bound between two first words is a node of the first level, one
    between two second words a node of the second.
    """

    BURST, MOST = 1 << 16, 1 << 20

    def __init__(self):
        self.bounds = np.zeros(1, np.uint64)
        self.leaves: list[list[np.ndarray]] = [[]]
        self.size = 0

    def add(self, rows: np.ndarray) -> None:
        """rows: (4, m) of path, rest, gram, n."""
        rows = rows[:, np.argsort(rows[0], kind="stable")]
        at = np.searchsorted(rows[0], self.bounds[1:])
        cut = np.r_[0, at, rows.shape[1]]
        for i in np.flatnonzero(np.diff(cut))[::-1].tolist():
            self.leaves[i].append(rows[:, cut[i] : cut[i + 1]])
            if sum(x.shape[1] for x in self.leaves[i]) > self.BURST:
                self._burst(i)
        self.size = sum(x.shape[1] for leaf in self.leaves for x in leaf)

    @staticmethod
    def _hashed(leaf: list[np.ndarray]) -> np.ndarray:
        """A container's entries, one for each phrase."""
        rows = np.concatenate(leaf, axis=1)
        _, first, of = np.unique(rows[2], return_index=True, return_inverse=True)
        total = np.zeros(len(first), np.uint64)
        np.add.at(total, of, rows[3])
        return np.vstack([rows[:3, first], total])

    def _burst(self, i: int) -> None:
        rows = self._hashed(self.leaves[i])
        self.leaves[i] = [rows]
        if rows.shape[1] <= self.BURST // 2:
            return
        path = np.sort(rows[0])
        middle, least, most = path[len(path) // 2], path[0], path[-1]
        node = middle & ~_WORD
        cut = next((c for c in (node, node + _WORD + np.uint64(1), middle, middle + np.uint64(1)) if least < c <= most), None)
        if cut is None:  # one pair of first words: the trie is no deeper
            return
        right = rows[0] >= cut
        self.leaves[i : i + 1] = [[rows[:, ~right]], [rows[:, right]]]
        self.bounds = np.insert(self.bounds, i + 1, cut)

    def spilled(self, most: int):
        """Sorted runs of the largest subtrees, whole, until at most that many entries are left."""
        self.leaves = [[self._hashed(x)] if x else [] for x in self.leaves]
        sizes = [x[0].shape[1] if x else 0 for x in self.leaves]
        self.size = sum(sizes)
        if most and self.size <= self.MOST * 3 // 4:
            return
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            if self.size <= most:
                break
            if sizes[i]:
                rows, self.leaves[i] = self.leaves[i][0], []
                self.size -= sizes[i]
                yield rows[:, np.lexsort((rows[1], rows[0]))]


class _Names:
    """Numbers of words within a task, by their hashes; 0 is no word."""

    def __init__(self):
        self.keys, self.numbers, self.words, self.size = np.zeros(0, np.uint64), np.zeros(0, np.uint64), [b""], 0

    def known(self, hashes: np.ndarray, buf: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        u, at = np.unique(hashes, return_index=True)
        new = ~np.isin(u, self.keys)
        for i in at[new].tolist():
            self.words.append(buf[first[i] : last[i]].tobytes())
            self.size += int(last[i] - first[i])
        if new.any():
            keys = np.r_[self.keys, u[new]]
            numbers = np.r_[self.numbers, np.arange(len(self.words) - new.sum(), len(self.words), dtype=np.uint64)]
            order = np.argsort(keys)
            self.keys, self.numbers = keys[order], numbers[order]
        return self.numbers[np.searchsorted(self.keys, hashes)]


def _salt(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


#: Entries of packed runs that a prefix partition should hold.
PREFIX_ROWS = 1 << 22


def _slots(gram: np.ndarray, prefixes: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix partition of each phrase, and 32 other bits of its hash."""
    return gram % np.uint64(prefixes), gram >> np.uint64(32)


def _slot_hash(prefix: np.ndarray, key: np.ndarray) -> np.ndarray:
    return mix((prefix << np.uint64(32)) | key)


def _planes(x: np.ndarray) -> bytes:
    """Small 32-bit numbers, first bytes first: those that are all zero compress away."""
    return x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view(np.uint32).ravel().astype(np.uint64)


def _packed(gram: np.ndarray, n: np.ndarray, prefixes: int) -> pa.RecordBatch:
    """A run as (prefix, keys, counts): of each prefix the ascending keys, as differences, and their counts."""
    prefix, key = _slots(gram, prefixes)
    order = np.lexsort((key, prefix))
    prefix, key, n = prefix[order], key[order], n[order]
    cut = np.r_[np.flatnonzero(np.r_[True, prefix[1:] != prefix[:-1]]), len(prefix)] if len(prefix) else np.zeros(1, np.int64)
    cols = [[], [], []]
    for i, j in zip(cut[:-1].tolist(), cut[1:].tolist()):
        cols[0].append(int(prefix[i]))
        cols[1].append(_planes(np.diff(key[i:j], prepend=np.uint64(0))))
        cols[2].append(_planes(np.minimum(n[i:j], np.uint64(0xFFFFFFFF))))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], ["prefix", "keys", "counts"])


def _frequent_slots(runs: DataFrame, least: int) -> DataFrame:
    """(slot): of the packed runs, merged by prefix, what is counted `least` times or more; the slot is a hash of prefix and key."""
    def merge(df: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([np.cumsum(_numbers(x)) for x in df["keys"]])
        counts = np.concatenate([_numbers(x) for x in df["counts"]])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        often = np.add.reduceat(counts, first) >= least
        found = keys[first][often]
        return pd.DataFrame({"slot": _slot_hash(np.full(len(found), df["prefix"].iloc[0], np.uint64), found).view(np.int64)})

    return runs.groupBy("prefix").applyInPandas(thrifty_group(merge), "slot long")


def _counted_in_tasks(docs: DataFrame, k: int, words=None, bits: int = 0, part: int = 0, parts: int = 1, prefixes: int = 0, slots: int = 0) -> DataFrame:
    """lang, phrase, gram, n: sorted runs of the phrases of k words whose parts of k - 1 words may be in the filter `words`.

    Of several rounds each takes the phrases whose first part's hash is in its slice. With `prefixes` the runs are packed, see _packed; with
    `slots` the filter holds the phrases' own slots of so many prefixes.
    """
    def grams(hashes, k, salt):
        g = gram_hashes(hashes, k)
        return mix(g ^ salt[: len(g)] ^ np.uint64(k))

    def rows_of(trie, names, langs, most):
        if prefixes:
            # One run of all subtrees that are spilled now: packed runs are sorted by prefix anyway.
            runs = list(trie.spilled(most))
            if runs:
                yield _packed(*np.concatenate(runs, axis=1)[2:], prefixes)
            return
        text, of = pa.array(names.words, pa.binary()), pa.array(list(langs), pa.string())
        for path, rest, gram, n in trie.spilled(most):
            cols = [(path >> np.uint64(WORD_BITS)) & _WORD, path & _WORD, *[(rest >> np.uint64(WORD_BITS * i)) & _WORD for i in (2, 1, 0)]][:k]
            phrase = pc.binary_join_element_wise(*[text.take(pa.array(c)) for c in cols], b" ") if k > 1 else text.take(pa.array(cols[0]))
            # A phrase of invalid UTF-8 can't be: words end at ASCII bytes.
            yield pa.RecordBatch.from_arrays([of.take(pa.array(path >> np.uint64(2 * WORD_BITS))), phrase.cast(pa.string()), pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "phrase", "gram", "n"])

    def run(batches):
        trie, names, langs, salts = HatTrie(), _Names(), {}, []
        for b in batches:
            if len(langs) > MOST_LANGS:
                yield from rows_of(trie, names, langs, 0)
                langs, salts = {}, []
            coded = b.column("lang").dictionary_encode()
            for lang in coded.dictionary.to_pylist():
                if langs.setdefault(lang, len(langs)) == len(salts):
                    salts.append(_salt(lang))
            number = np.array([langs[x] for x in coded.dictionary.to_pylist()], np.uint64)[coded.indices.to_numpy()]
            for codes, buf, starts, ends in pieces(pa.array(number), b.column("text")):
                low = _LOWER[buf]
                first, last, count = word_spans(low, starts, ends, _APART)
                if len(first) < k:
                    continue
                hashes = word_hashes(low, first, last)
                of = np.repeat(np.arange(len(count)), count)
                breaks = np.cumsum(_BREAK[low])[first]
                piece = np.cumsum(np.r_[True, (of[1:] != of[:-1]) | (breaks[1:] != breaks[:-1])])
                lang = codes[of]
                salt = np.array(salts, np.uint64)[lang.astype(np.int64)]
                ok = piece[: len(piece) - k + 1] == piece[k - 1 :]
                if k > 1:
                    parts_of = grams(hashes, k - 1, salt)
                    if parts > 1:
                        ok &= (parts_of[:-1] >> np.uint64(1)) % np.uint64(parts) == np.uint64(part)
                    at = np.flatnonzero(ok)
                    if slots:
                        at = at[held(words.value, _slot_hash(*_slots(grams(hashes, k, salt)[at], slots)), bits)]
                    else:
                        at = at[held(words.value, parts_of[at], bits)]
                        # The filter of a slice doesn't know the second part of a phrase.
                        at = at[held(words.value, parts_of[at + 1], bits)] if parts == 1 else at
                else:
                    at = np.flatnonzero(ok)
                gram, where, n = np.unique(grams(hashes, k, salt)[at], return_index=True, return_counts=True)
                at = at[where]
                each = (at[None, :] + np.arange(k)[:, None]).ravel()
                numbers = np.zeros((LONGEST, len(at)), np.uint64)
                numbers[:k] = names.known(hashes[each], low, first[each], last[each]).reshape(k, len(at))
                shift = np.uint64(WORD_BITS)
                trie.add(np.vstack([(((lang[at] << shift) | numbers[0]) << shift) | numbers[1], (((numbers[2] << shift) | numbers[3]) << shift) | numbers[4], gram, n.astype(np.uint64)]))
                full = len(names.words) > 1 << (WORD_BITS - 1) or names.size > MOST_NAME_BYTES
                if full or trie.size > trie.MOST:
                    yield from rows_of(trie, names, langs, 0 if full else trie.MOST // 2)
                if full:
                    names = _Names()
        yield from rows_of(trie, names, langs, 0)

    return docs.mapInArrow(thrifty(run), "prefix long, keys binary, counts binary" if prefixes else "lang string, phrase string, gram long, n long")


def _merged(runs: DataFrame) -> DataFrame:
    """The runs of all tasks, added up where their prefix is dealt to: one exchange, by language and first two words."""
    prefix = F.substring_index("phrase", " ", 2)
    dealt = runs.withColumn("prefix", prefix).repartition("lang", "prefix")
    return dealt.groupBy("lang", "prefix", "phrase").agg(F.min("gram").alias("gram"), F.sum("n").alias("f")).drop("prefix")


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) of all phrases of up to `longest` words with f >= least, single words included; and (lang, n), all words."""
    spark = docs.sparkSession
    rows = small_batches(docs).select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    words = written(_merged(_counted_in_tasks(rows, 1)), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    level, seen = counted(words.filter(F.col("f") >= least), "phrases")
    levels = [level.withColumn("k", F.lit(1))]
    size = lambda n: min(28, max(16, int(np.ceil(np.log2(16 * min(max(n, 1), ROUND_KEYS))))))
    for k in range(2, longest + 1):
        if not seen["n"]:
            break
        parts, bits = -(-seen["n"] // ROUND_KEYS), size(seen["n"])
        runs = None
        for part in range(parts):
            keys = level.select("gram") if parts == 1 else level.filter(F.expr(f"shiftrightunsigned(gram, 1) % {parts} = {part}")).select("gram")
            filled = spark.sparkContext.broadcast(hash_bit_set(keys, "gram", bits))
            found = _counted_in_tasks(rows, k, filled, bits, part, parts)
            if k == 2:
                prefixes = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(totals.agg(F.sum("n")).head()[0] or 0) // PREFIX_ROWS))
                slots, kept = counted(_frequent_slots(_counted_in_tasks(rows, k, filled, bits, part, parts, prefixes), least), "slots")
                filled.unpersist()
                own = size(kept["n"])
                filled = spark.sparkContext.broadcast(hash_bit_set(slots, "slot", own))
                found = _counted_in_tasks(rows, k, filled, own, part, parts, slots=prefixes)
            mine = written(_merged(found).filter(F.col("f") >= least), "phrases")
            filled.unpersist()
            runs = mine if runs is None else runs.unionByName(mine)
        level, seen = counted(runs, "phrases") if parts > 1 else (runs, {"n": runs.count()})
        levels.append(level.withColumn("k", F.lit(k)))
    found = levels[0]
    for x in levels[1:]:
        found = found.unionByName(x)
    return found.select("lang", "phrase", "k", "f"), totals


def collocations(docs: DataFrame, most: int = 2000, least: int = LEAST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `most` phrases."""
    counts, totals = phrase_counts(docs, least)
    found = counts.filter("k > 1").withColumnRenamed("f", "a")
    # Everything that a longer phrase of the same frequency holds goes.
    inner = F.expr("flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), s -> concat_ws(' ', slice(w, s, m)))))")
    inside = found.filter("k > 2").withColumn("w", F.split("phrase", " ")).select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    whole = found.join(inside, ["lang", "phrase"], "left").filter("longer IS NULL OR longer < a").drop("longer")
    w = F.split("phrase", " ")
    cuts = whole.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).withColumn("first", F.expr("substring_index(phrase, ' ', cut)")).withColumn("rest", F.concat_ws(" ", F.slice(w, F.col("cut") + 1, F.col("k"))))
    side = lambda name, f: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    scored = (
        cuts.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"]).join(checked_broadcast(totals), "lang")
        .withColumn("score", F.expr("(CAST(1000 * a AS DECIMAL(19, 0)) * CAST(n AS DECIMAL(19, 0))) div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))"))
    )
    lowest = F.min_by(F.struct("a", "l", "r", "n", "score"), F.struct("score", "cut")).alias("x")
    best = scored.groupBy("lang", "phrase").agg(lowest).select("lang", "phrase", "x.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({lower}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, unnest(flatten(list_transform(range(1, 6), lambda k: list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])))) AS g FROM w),
f AS (SELECT lang, g, len(g) AS k, count(*) AS f FROM g GROUP BY lang, g HAVING count(*) >= 100),
s AS (SELECT lang, unnest(flatten(list_transform(range(2, k), lambda m: list_transform(range(1, k - m + 2), lambda i: g[i:i + m - 1])))) AS g, f FROM f WHERE k > 2),
c AS (SELECT f.* FROM f LEFT JOIN (SELECT lang, g, max(f) AS f FROM s GROUP BY ALL) x USING (lang, g) WHERE k > 1 AND (x.f IS NULL OR 100 * x.f < 100 * f.f)),
u AS (SELECT c.lang, c.g, c.f AS a, unnest(range(1, k)) AS cut FROM c),
v AS (SELECT u.lang, u.g, a, cut, x.f AS l, y.f AS r, n, CAST((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
      FROM u JOIN f x ON x.lang = u.lang AND x.g = u.g[:cut] JOIN f y ON y.lang = u.lang AND y.g = u.g[cut + 1:] JOIN t ON t.lang = u.lang),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) AS best FROM v) WHERE best = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM (SELECT *, array_to_string(g, ' ') AS phrase FROM b)) WHERE rank <= 2000
"""


SQL = _sql()
