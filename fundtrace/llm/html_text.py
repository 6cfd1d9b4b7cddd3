"""Main text of web pages by wrapper induction over each host's pages.

A few different pages of a host, chosen by hash, are its references. Every page's tree of blocks is aligned with them by
simple tree matching; a block of a reference is a slot, and the pages' blocks matched with it fill it. Over the host's
pages, slots whose text stays the same are template; of what varies, length, link share and headings lead to the region of the
article, and that is the wrapper. Within the region whatever varies is kept at any length; an element's name counts against it
only together with other features. A page is read through the wrapper of the reference that it matches best. A page identical to the reference has no vote, so copies of a page don't make its text constant.

Character references are decoded; white space inside a block becomes one space; blocks are joined by one space. Null or empty
html: empty text. A page of a host with fewer than MIN_PAGES different pages, without a host, or that no reference
matches, is a wrapper of its own: the same decision from its own slots. Pages of any size and nesting are matched in full.
Repeated page_ids or rows: each row is answered. Of equally good references the first by hash is taken. Empty table: no rows. Other columns
of the table, whatever their names, aren't read.
"""

import json
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundtrace.llm.dom import blocks, flat, in_order, match, own_stats, parse, text, wrapper
from fundtrace.llm.store import checked_broadcast, thrifty, written

REFERENCES = 3
MIN_PAGES = 2
#: Characters of references up to which they are broadcast; more are joined by host.
BROADCAST_CHARS = 48_000_000
#: Hosts whose parsed references a task keeps, and slots whose sums it keeps.
HELD_HOSTS, HELD_SLOTS = 200, 100_000


def _hosts(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), host.alias("host"), F.xxhash64(html).alias("h"))


def references(known: DataFrame) -> DataFrame:
    """(host, n, html, h): REFERENCES pages of each host with its number of different pages; known: see _hosts."""
    pages = known.filter("host != '' AND html != ''")
    seeds = range(REFERENCES)
    counts = pages.select("host", "h").distinct().groupBy("host").agg(F.count("*").alias("n"), *[F.min(F.struct(F.xxhash64("h", F.lit(i)), "h"))["h"].alias(f"r{i}") for i in seeds])
    counts = written(counts.filter(F.col("n") >= MIN_PAGES).select("host", "n", F.explode(F.array_distinct(F.array(*[f"r{i}" for i in seeds]))).alias("h")), "hosts")
    found = pages.join(checked_broadcast(counts), ["host", "h"]).groupBy("host", "h").agg(F.first("html").alias("html"), F.first("n").alias("n"))
    return written(found, "references")


def _with(known: DataFrame, by_host: DataFrame, chars: int, how: str) -> DataFrame:
    return known.join(F.broadcast(by_host) if chars <= BROADCAST_CHARS else by_host, "host", how)


def _parsed(held: dict, host, found) -> list:
    """Trees of a host's references, parsed once while the task keeps them."""
    if host not in held:
        if len(held) >= HELD_HOSTS:
            held.clear()
        held[host] = [(r, blocks(parse(r["html"]))) for r in found]
    return held[host]


READ = "page_id long, url string, host string, h long, page string, text string, slot int, k double, same double, own double, chars double, links double"
NAMES = [c.split()[0] for c in READ.split(", ")]
SUMS = NAMES[-5:]


def _read(known: DataFrame, by_host: DataFrame, chars: int) -> DataFrame:
    """Two kinds of rows, so that a page is parsed once. Of each page: h, the reference that it matches best, and page, its blocks
    (see dom.flat), or its text where there is no reference. Of each reference (host, h): sums over pages by slot."""
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), *[pa.float64()] * 5]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], NAMES)

    def run(batches):
        held, sums = {}, {}

        def part():
            rows = [(None, None, host, h, None, None, i, *v) for (host, h), a in sums.items() for i, v in enumerate(a.tolist())]
            sums.clear()
            return batch(rows)

        for b in batches:
            rows = []
            for at, (page_id, url, host, html, h, found) in enumerate(zip(*[b.column(c).to_pylist() for c in ("page_id", "url", "host", "html", "h", "found")])):
                page, best, of = blocks(parse(html)), [], None
                for r, tree in _parsed(held, host, found or ()):
                    pairs = match(tree, page)
                    if len(pairs) > len(best):
                        best, of = pairs, r["h"]
                    if r["h"] != h:
                        to = sums.setdefault((host, r["h"]), np.zeros((tree.size, 5)))
                        to[[x.slot for x, _ in pairs]] += [(1, x.own == y.own != 0, y.chars, y.all_chars, y.all_links) for x, y in pairs] if pairs else 0
                alone = None if best else text(flat(page, [(x, x) for x in in_order(page)]), wrapper(page, own_stats(page)))
                rows.append((page_id, url, host, of, json.dumps(flat(page, best), ensure_ascii=False) if best else None, alone, None, *[None] * 5))
                if len(rows) == 256:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)
            if sum(len(a) for a in sums.values()) > HELD_SLOTS:
                yield part()
        if sums:
            yield part()
        sys.setrecursionlimit(1000)

    return _with(known, by_host, chars, "left").select("page_id", "url", "host", "html", "h", "found").mapInArrow(thrifty(run), READ)


def _rules(chosen: DataFrame, cast: DataFrame) -> DataFrame:
    """(host, h, rules) of each reference; see dom.wrapper."""
    def run(batches):
        for b in batches:
            rules = [wrapper(blocks(parse(x)), np.array(s, float)).tolist() for x, s in zip(b.column("html").to_pylist(), b.column("stats").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("host"), b.column("h"), pa.array(rules, pa.list_(pa.int32()))], ["host", "h", "rules"])

    slots = cast.groupBy("host", "h", "slot").agg(*[F.sum(c).alias(c) for c in SUMS])
    stats = slots.groupBy("host", "h").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", *SUMS))), lambda s: F.array(*[s[c] for c in SUMS])).alias("stats"))
    return written(chosen.join(stats, ["host", "h"]).select("host", "h", "html", "stats").mapInArrow(thrifty(run), "host string, h long, rules array<int>"), "wrappers")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, by_wrapper (whether a wrapper of the host decided): one row for each row of pages."""
    known = _hosts(pages)
    chosen = references(known)
    chars = chosen.agg(F.sum(F.length("html"))).head()[0] or 0
    read = written(_read(known, chosen.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("h", "html"))).alias("found")), chars), "read")
    rules = _rules(chosen, read.filter("slot IS NOT NULL").select("host", "h", "slot", *SUMS))

    def run(batches):
        for b in batches:
            texts = [t if p is None else text(json.loads(p), r) for p, t, r in zip(*[b.column(c).to_pylist() for c in ("page", "text", "rules")])]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), b.column("page").is_valid()], ["page_id", "url", "text", "n_chars", "by_wrapper"])

    # A reference's rules are far shorter than its html.
    seen = read.filter("slot IS NULL").select("page_id", "url", "host", "h", "page", "text").join(F.broadcast(rules) if chars <= BROADCAST_CHARS else rules, ["host", "h"], "left")
    return seen.select("page_id", "url", "page", "text", "rules").mapInArrow(thrifty(run), "page_id long, url string, text string, n_chars long, by_wrapper boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
