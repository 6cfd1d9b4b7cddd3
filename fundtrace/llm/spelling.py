"""Spelling variants: words one inserted, deleted or replaced letter apart, found by pairs of trie nodes.

Words are maximal runs [A-Za-z\\u00C0-\\u00FF]+, A-Z lower-cased, of at least 5 letters that occur at least 3 times (`degrade` may change a
run before it counts). The distinct words are put in order and numbered. Nodes of the trie of the words and of the trie of the
reversed words are numbered too, so a word of m letters is m + 1 prefix nodes and m + 1 suffix nodes. Each place of it gives
two integer pairs: (prefix, suffix behind the next letter), which skips that letter, and (prefix, suffix), where one could be inserted. Words
that share a skipping pair differ by one replaced letter; a skipping pair that is another word's plain pair differs by one letter more. As
a pair and a letter make one word, no pair has more words than there are letters. Nothing is compared letter by letter afterwards.

The nodes of the words' ends are shared by much of the vocabulary; such nodes are few, as each has a fixed share of all, and are broadcast.
Nodes of long prefixes are told apart by SHA-256, so a word costs as much as its length.

Nulls and empty texts have no words; a run of a row without doc_id is never degraded. Repeated rows count again; of equally frequent near words the
first in code-point order is the form. A text or a word of any length is taken whole. An empty table gives no rows. Other columns are ignored.
"""

import hashlib
import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundtrace.llm.features import text_rows
from fundtrace.llm.store import checked_broadcast, counted, thrifty, written

LETTERS, OCCURRENCES = 5, 3
#: Distinct words that a task counts at a time.
MOST_WORDS = 200_000
#: Nodes that more than this share of all places have are broadcast: at most 1 / SHARE of them.
SHARE = 1 / 4096
#: A prefix of more bytes stands for itself by its SHA-256.
PLAIN_BYTES = 32
_RUN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf])+")


def degraded(doc_id: int | None, run: str) -> str:
    """The run without one letter if 97 divides the crc32 of `doc_id:run`, as texts have misprints; else as it is."""
    if doc_id is None or (h := zlib.crc32(f"{doc_id}:{run}".encode())) % 97:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, change=degraded) -> DataFrame:
    """word, n: how often each word of LETTERS or more letters occurs, as `change` (of doc_id and run) leaves it."""
    def run(batches):
        total = Counter()
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                raw = text.as_buffer() if text.is_valid else b""
                # One document at a time; bytes.lower changes A-Z only. Runs come one by one, so a long text makes no long list.
                for w, n in Counter(m.group().lower() for m in _RUN.finditer(raw)).items():
                    word = change(doc_id, w.decode())
                    if len(word) >= LETTERS:
                        total[word] += n
                if len(total) > MOST_WORDS:
                    yield pa.RecordBatch.from_pydict({"word": pa.array(total.keys(), pa.string()), "n": pa.array(total.values(), pa.int64())})
                    total = Counter()
        yield pa.RecordBatch.from_pydict({"word": pa.array(total.keys(), pa.string()), "n": pa.array(total.values(), pa.int64())})

    return text_rows(docs).mapInArrow(thrifty(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _places(words: DataFrame) -> DataFrame:
    """id, at, reverse, path: of each word the prefixes up to each place, and the suffixes from each place, both from their trie's root."""
    def paths(letters):
        so_far, plain = hashlib.sha256(), b""
        yield plain
        for c in letters:
            c = c.encode()
            so_far.update(c)
            plain = plain + c if len(plain) <= PLAIN_BYTES else plain
            yield plain if len(plain) <= PLAIN_BYTES else b"#" + so_far.digest()

    def run(batches):
        for b in batches:
            cols = [[], [], [], []]
            for i, word in zip(b.column("id").to_pylist(), b.column("word").to_pylist()):
                for reverse in (False, True):
                    for at, path in enumerate(paths(word[::-1] if reverse else word)):
                        for c, v in zip(cols, (i, len(word) - at if reverse else at, reverse, path)):
                            c.append(v)
                if len(cols[0]) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.bool_()), pa.array(cols[3], pa.binary())], ["id", "at", "reverse", "path"])
                    cols = [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.bool_()), pa.array(cols[3], pa.binary())], ["id", "at", "reverse", "path"])

    return words.mapInArrow(thrifty(run), "id long, at int, reverse boolean, path binary")


def _numbered(places: DataFrame, total: int) -> DataFrame:
    """id, at, reverse, node: paths replaced by numbers of their nodes, unique over both tries."""
    nodes = written(places.groupBy("reverse", "path").agg(F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    often = nodes.filter(F.col("n") > total * SHARE).select("reverse", "path", "node")
    # Places at shared nodes take their numbers from a broadcast; the others are few for each node and shuffled.
    first = places.join(F.broadcast(often), ["reverse", "path"], "left")
    return first.filter("node IS NOT NULL").select("id", "at", "reverse", "node").unionByName(
        first.filter("node IS NULL").drop("node").join(nodes.filter(F.col("n") <= total * SHARE).select("reverse", "path", "node"), ["reverse", "path"]).select("id", "at", "reverse", "node"))


def near_words(words: DataFrame) -> DataFrame:
    """(id, near): both directions of each pair of words, of `words` (id, word), one edit apart."""
    places, seen = counted(_places(words), "places")
    numbered = _numbered(places, seen["n"])
    line = lambda reverse: F.transform(F.array_sort(F.collect_list(F.when(F.col("reverse") == reverse, F.struct("at", "node")))), lambda x: x["node"])
    lines = written(numbered.groupBy("id").agg(line(False).alias("p"), line(True).alias("s")), "lines")
    pair = lambda shift: lines.select("id", F.explode(F.arrays_zip(F.slice("p", 1, F.size("p") - shift).alias("p"), F.slice("s", 1 + shift, F.size("s") - shift).alias("s"))).alias("x")).select("id", "x.p", "x.s")
    skipped, plain = pair(1), pair(0)
    other = skipped.withColumnRenamed("id", "near")
    replaced = skipped.join(other, ["p", "s"]).filter("id != near").select("id", "near")
    longer = skipped.join(plain.withColumnRenamed("id", "near"), ["p", "s"]).select("id", "near")
    found = replaced.unionByName(longer).unionByName(longer.select(F.col("near").alias("id"), F.col("id").alias("near")))
    return found.distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(id, root) of (id, form): forms followed to their ends. n at least doubles along a chain, so it is short and has no cycle."""
    now, seen = counted(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        ahead = checked_broadcast(now.select(F.col("id").alias("root"), F.col("root").alias("next")), seen["n"])
        step, seen = counted(now.join(ahead, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots", moved=F.count_if("moved"))
        now = step.select("id", "root")
        if not seen["moved"]:
            return now


def variants(docs: DataFrame, change=degraded) -> DataFrame:
    """word, form, root, n, n_near, form_n."""
    ordered = word_counts(docs, change).filter(F.col("n") >= OCCURRENCES).orderBy("word")
    words = written(ordered.withColumn("id", F.monotonically_increasing_id()), "words")  # ids ascend as words do
    near = near_words(words.select("id", "word")).join(words.select(F.col("id").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("id").agg(F.count("*").alias("n_near"), F.max(F.struct("near_n", (-F.col("near")).alias("first"))).alias("best"))
    found = written(words.join(best, "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("best.near_n") >= 2 * F.col("n"), -F.col("best.first")).alias("form")), "variants")
    roots = _roots(found.filter("form IS NOT NULL").select("id", "form"))
    name = lambda k: words.select(F.col("id").alias(k), F.col("word").alias(f"{k}_word"), F.col("n").alias(f"{k}_n"))
    return (
        found.join(roots, "id", "left").join(name("form"), "form", "left").join(name("root"), "root", "left")
        .select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    """The table of the crc is made by its rule."""
    return rf"""
WITH RECURSIVE bits(v, c, i) AS (SELECT range, range, 0 FROM range(256) UNION ALL SELECT v, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, i + 1 FROM bits WHERE i < 8),
crc_table AS (SELECT list(c ORDER BY v) AS t FROM bits WHERE i = 8),
r AS (SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents) GROUP BY ALL),
h AS (SELECT w, n, xor(4294967295::BIGINT, list_reduce(list_transform(range(0, strlen(k)), lambda i: ('0x' || substr(hex(k), 2 * i + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT)) AS h
      FROM (SELECT w, n, CAST(doc_id AS VARCHAR) || ':' || w AS k FROM r) x, crc_table),
o AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM o WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
g AS (SELECT word, n, substr(word, 1, i) AS p, substr(word, i + 2) AS s FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM v)),
j AS (SELECT word, n, substr(word, 1, i) AS p, substr(word, i + 1) AS s FROM (SELECT word, n, unnest(range(0, length(word) + 1)) AS i FROM v)),
l AS (SELECT g.word, j.word AS near FROM g JOIN j USING (p, s)),
e AS (SELECT x.word, y.word AS near FROM g x JOIN g y ON x.p = y.p AND x.s = y.s AND x.word != y.word UNION SELECT * FROM l UNION SELECT near, word FROM l),
b AS (SELECT e.word, count(*) AS n_near, max(v.n) AS form_n FROM e JOIN v ON v.word = e.near GROUP BY e.word),
m AS (SELECT e.word, min(e.near) AS form FROM e JOIN v ON v.word = e.near JOIN b ON b.word = e.word AND b.form_n = v.n GROUP BY e.word),
f AS (SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.form_n >= 2 * v.n THEN m.form END AS form, CASE WHEN b.form_n >= 2 * v.n THEN b.form_n END AS form_n FROM v LEFT JOIN b USING (word) LEFT JOIN m USING (word)),
c AS (SELECT word, word AS last FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.last WHERE f.form IS NOT NULL),
z AS (SELECT c.word, c.last AS root FROM c JOIN f ON f.word = c.last WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN z ON z.word = f.word
"""


SQL = _sql()
