"""Scatter-gather pattern: accounts A and B with more than five paths A -> M -> B through gated hops."""

import math
import weakref

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fundtrace.functions import reference_values as V
from fundtrace.functions.expressions import bank_id, in_text_window, is_usd, stripped
from fundtrace.operators import blocks
from fundtrace.operators.transfers import closed

EDGE = ("src_bank", "src_account", "dst_bank", "dst_account")


def edges(tx: DataFrame, keys: tuple = ()) -> DataFrame:
    return tx.filter(is_usd() & in_text_window(V.BASELINE_WINDOW)).select(
        *keys, bank_id(F.col("from_bank")).alias("src_bank"), stripped(F.col("from_account")).alias("src_account"),
        bank_id(F.col("to_bank")).alias("dst_bank"), stripped(F.col("to_account")).alias("dst_account"))


def counted(e: DataFrame, keys: tuple = ()) -> DataFrame:
    """Edges with their multiplicity: what every later step works on."""
    return e.groupBy(*keys, *EDGE).agg(F.count("*").alias("n"))


def qualifying_sources(c: DataFrame, above: int = V.FAN_OUT_ABOVE, keys: tuple = ()) -> DataFrame:
    """Sources with more than `above` distinct targets, themselves included; c has one row per edge."""
    return (
        c.groupBy(*keys, F.col("src_bank").alias("bank_id"), F.col("src_account").alias("account"))
        .agg(F.count("*").alias("n_targets")).filter(F.col("n_targets") > above)
    )


def gated(e: DataFrame, sources: DataFrame, keys: tuple = ()) -> DataFrame:
    s = sources.select(*keys, F.col("bank_id").alias("src_bank"), F.col("account").alias("src_account"))
    return e.join(s, [*keys, "src_bank", "src_account"], "left_semi").select(*e.columns)


def intermediaries(g: DataFrame) -> DataFrame:
    return g.select(F.col("dst_bank").alias("bank_id"), F.col("dst_account").alias("account")).intersect(g.select("src_bank", "src_account"))


def _sides(g: DataFrame, keys: tuple) -> tuple[DataFrame, DataFrame]:
    first = g.select(*keys, F.col("src_bank").alias("a_bank"), F.col("src_account").alias("a_account"), F.col("dst_bank").alias("m_bank"), F.col("dst_account").alias("m_account"), F.col("n").alias("n1"))
    second = g.select(*keys, F.col("src_bank").alias("m_bank"), F.col("src_account").alias("m_account"), F.col("dst_bank").alias("b_bank"), F.col("dst_account").alias("b_account"), F.col("n").alias("n2"))
    return first, second


def _summed(joined: DataFrame, keys: tuple) -> DataFrame:
    return (
        joined.filter("a_bank != b_bank OR a_account != b_account").groupBy(*keys, "a_bank", "a_account", "b_bank", "b_account")
        .agg(F.sum(F.col("n1") * F.col("n2")).alias("n_paths"))
    )


#: Pairs of ends from which on an intermediary is dealt over a grid of blocks, and the sides of the grid.
HOT_PAIRS, GRID = 1_000_000, (16, 16)


def hot_intermediaries(g: DataFrame, above: int = HOT_PAIRS, keys: tuple = ()) -> DataFrame:
    """(m_bank, m_account) whose sources times targets are more than `above`, from the counted edges."""
    ends = lambda x, n: g.groupBy(*keys, F.col(f"{x}_bank").alias("m_bank"), F.col(f"{x}_account").alias("m_account")).agg(F.count("*").alias(n))
    m = [*keys, "m_bank", "m_account"]
    return ends("dst", "sources").join(ends("src", "targets"), m).filter(F.col("sources") * F.col("targets") > above).select(*m)


def two_hop_paths(g: DataFrame, keys: tuple = (), hot_pairs: int = HOT_PAIRS, grid: tuple[int, int] = GRID) -> DataFrame:
    """Number of paths per pair of different ends, by multiplicity; g: counted gated edges.

    Many paths are made in blocks of ends (`_sides_of_blocks`). Of few, an intermediary with more than hot_pairs pairs of ends is dealt over a
    grid of blocks, so that no task makes all its pairs; the others are one block. The edges are kept as long as the result is.
    """
    g, own = _kept(g)
    first, second = _sides(g, keys)
    sides = _sides_of_blocks(first, second, keys)
    if sides:
        found = blocks.paired(first, second, keys, sides)
    else:
        found = _summed(_in_blocks(first, second, hot_intermediaries(g, hot_pairs, keys), keys, grid), keys)
    return _holding(found, g, own)


#: Paths up to which edges are joined; edges of a block's side; paths of a block.
FEW_PATHS, BLOCK_EDGES, BLOCK_PATHS = 1_000_000, 500_000, 50_000_000


def _sides_of_blocks(first: DataFrame, second: DataFrame, keys: tuple) -> tuple[int, int] | None:
    """The grid of blocks for `blocks.paired`; None if paths are so few that joining moves less, or so many that their number may overflow.

    A join shuffles nearly a row for each path, as the paths of a pair have different intermediaries; blocks shuffle the first hops once for each column and the
    second ones once for each row.
    """
    m = [*keys, "m_bank", "m_account"]
    x = first.groupBy(*m).agg(F.count("*").alias("x"), F.sum(F.col("n1").cast("double")).alias("x_n"))
    y = second.groupBy(*m).agg(F.count("*").alias("y"), F.sum(F.col("n2").cast("double")).alias("y_n"))
    made = F.sum(F.col("x").cast("double") * F.col("y"))
    each = x.join(y, m).groupBy(*keys).agg(F.sum("x").alias("x"), F.sum("y").alias("y"), made.alias("paths"), F.sum(F.col("x_n") * F.col("y_n")).alias("n_paths"))
    r = each.agg(*(f(c).alias(f"{f.__name__}_{c}") for c in each.columns if c not in keys for f in (F.max, F.sum))).first()
    if r.sum_paths is None or r.sum_paths <= FEW_PATHS or r.max_n_paths >= 2**62:
        return None
    more = math.sqrt(r.max_paths / BLOCK_PATHS)
    sides = tuple(math.ceil(max(n / BLOCK_EDGES, more, 1)) for n in (r.max_x, r.max_y))
    return sides if r.sum_x * sides[1] + r.sum_y * sides[0] < r.sum_paths else None


def _kept(g: DataFrame) -> tuple[DataFrame, bool]:
    """g persisted, and whether it wasn't before."""
    level = g.storageLevel
    return (g, False) if level.useMemory or level.useDisk else (g.persist(), True)


def _holding(found: DataFrame, g: DataFrame, own: bool = True) -> DataFrame:
    """found, with which g stays persisted."""
    if own:
        weakref.finalize(found, g.unpersist)
    return found


def _in_blocks(first: DataFrame, second: DataFrame, hot: DataFrame, keys: tuple, grid: tuple[int, int]) -> DataFrame:
    """First hops joined with second ones; those of a hot intermediary meet in the blocks of a grid."""
    m = [*keys, "m_bank", "m_account"]
    blocks = lambda n: F.when(F.col("hot"), F.lit(n)).otherwise(1)
    block = lambda end, n: F.pmod(F.hash(f"{end}_bank", f"{end}_account"), blocks(n))
    each = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    hot = hot.withColumn("hot", F.lit(True))
    first = first.join(hot, m, "left").withColumn("a_block", block("a", grid[0])).withColumn("b_block", each(grid[1]))
    second = second.join(hot, m, "left").withColumn("b_block", block("b", grid[1])).withColumn("a_block", each(grid[0]))
    return first.drop("hot").join(second.drop("hot"), [*m, "a_block", "b_block"])


def two_hop_salted(g: DataFrame, a_buckets: int = 4, b_buckets: int = 4, keys: tuple = ()) -> DataFrame:
    """The same with every intermediary dealt over a grid of blocks."""
    return two_hop_paths(g, keys, 0, (a_buckets, b_buckets))


def pairs(paths: DataFrame, above: int = V.PATHS_ABOVE) -> DataFrame:
    found = paths.filter(F.col("n_paths") > above)
    weakref.finalize(found, id, paths)  # what paths holds stays persisted
    return found


#: Paths from which on a pair counts: sums needn't go on beyond it.
ENOUGH = V.PATHS_ABOVE + 1


def _saturated(g: DataFrame, most: int) -> DataFrame:
    """Edges whose multiplicity stops at most: a product of two is most or more exactly if that of the full ones is, and no sum overflows."""
    return g.withColumn("n", F.least("n", F.lit(most)))


def pruned(g: DataFrame, enough: int = ENOUGH, keys: tuple = ()) -> tuple[DataFrame, DataFrame]:
    """The first and the second hops, of gated counted edges (src_*, dst_*, n), that can be part of a pair with `enough` paths.

    A source has at most its edges' multiplicities, each times the largest one that leaves the edge's target, paths to any one account, and a target as many from any
    one. Ends that can't reach `enough` go before any pair is made.
    """
    g = _saturated(g, enough)
    source, target = [*keys, "src_bank", "src_account"], [*keys, "dst_bank", "dst_account"]

    def kept(hops: DataFrame, others: DataFrame, end: list, middle: list, other: list) -> DataFrame:
        best = others.groupBy(*other).agg(F.max("n").alias("most")).withColumnsRenamed(dict(zip(other, middle)))
        good = hops.join(best, middle).groupBy(*end).agg(F.sum(F.col("n") * F.col("most")).alias("bound")).filter(F.col("bound") >= enough)
        return hops.join(good.drop("bound"), end, "left_semi")

    first = kept(g, g, source, target, source)
    return first, kept(g, first, target, source, target)


def pairs_pruned(g: DataFrame, enough: int = ENOUGH, keys: tuple = (), hot_pairs: int = HOT_PAIRS, grid: tuple[int, int] = GRID) -> DataFrame:
    """(a_bank, a_account, b_bank, b_account, n_paths): pairs with `enough` paths or more, n_paths saturated there; g: gated counted edges.

    Many paths are made in blocks. Of few, whether there are hot intermediaries is asked first, so that edges are joined with them only if there are.
    """
    g, own = _kept(g)
    x, y, sides = _pruned_sides(g, enough, keys)
    if sides:
        found = blocks.paired(x, y, keys, sides, enough)
    else:
        hot = closed(hot_intermediaries(g, hot_pairs, keys))
        joined = x.join(y, [*keys, "m_bank", "m_account"]) if hot.isEmpty() else _in_blocks(x, y, hot, keys, grid)
        found = _summed(joined, keys).filter(F.col("n_paths") >= enough)
    return _holding(found.withColumn("n_paths", F.lit(enough).cast("long")), g, own)


def _pruned_sides(g: DataFrame, enough: int, keys: tuple) -> tuple[DataFrame, DataFrame, tuple[int, int] | None]:
    """First and second hops without those that can't matter, and the grid of blocks by the edges before that."""
    first, second = pruned(g, enough, keys)
    return _sides(first, keys)[0], _sides(second, keys)[1], _sides_of_blocks(*_sides(_saturated(g, enough), keys), keys)


#: Rows of source and target that a task keeps before it hands capped sets on.
KEPT_ROWS = 500_000


def capped_targets(e: DataFrame, most: int = V.FAN_OUT_ABOVE + 1, keys: tuple = ()) -> DataFrame:
    """(src_bank, src_account, n_targets): distinct targets of each source, itself included, but no more than `most` are counted.

    Each task stops a source's set at `most` members before anything is shuffled, so a source with 10 ** 8 targets sends `most` rows a task;
    where they meet, ranks over the targets stop there too.
    """
    by = [*keys, "src_bank", "src_account"]
    cols = [*keys, *EDGE]

    def run(batches):
        kept = None
        for b in batches:
            part = b.to_pandas().drop_duplicates()
            kept = part if kept is None else pd.concat([kept, part]).drop_duplicates()
            kept = kept[kept.groupby(by, dropna=False, sort=False).cumcount() < most]
            if len(kept) > KEPT_ROWS:
                yield pa.RecordBatch.from_pandas(kept, schema=b.schema, preserve_index=False)
                kept = None
        if kept is not None:
            yield pa.RecordBatch.from_pandas(kept, schema=b.schema, preserve_index=False)

    rank = F.dense_rank().over(Window.partitionBy(*by).orderBy("dst_bank", "dst_account"))
    some = e.select(*cols).mapInArrow(run, e.select(*cols).schema)
    return some.withColumn("rank", rank).filter(F.col("rank") <= most).groupBy(*by).agg(F.max("rank").cast("long").alias("n_targets"))


def qualifying_capped(e: DataFrame, above: int = V.FAN_OUT_ABOVE, keys: tuple = ()) -> DataFrame:
    """(bank_id, account) of the sources with more than `above` distinct targets, by capped sets; e: edges, not counted yet."""
    found = capped_targets(e, above + 1, keys).filter(F.col("n_targets") > above)
    return found.select(*keys, F.col("src_bank").alias("bank_id"), F.col("src_account").alias("account"))


#: Hexadecimal digits of a hash that say in which bucket an account is numbered: 16 ** 3 buckets.
BUCKET_DIGITS = 3


def vertices(e: DataFrame, keys: tuple = ()) -> DataFrame:
    """(bank_id, account, vertex): the accounts of edges, numbered from 0 without gaps, by bucket of their MD5, then bank, then account.

    Each bucket numbers its own accounts and the buckets' sizes give the offsets, so the numbers depend on nothing but the accounts.
    """
    ends = [e.select(*keys, F.col(f"{x}_bank").alias("bank_id"), F.col(f"{x}_account").alias("account")) for x in ("src", "dst")]
    every = ends[0].unionByName(ends[1]).distinct()
    bucket = F.substring(F.md5(F.concat_ws("|", "bank_id", "account").cast("binary")), 1, BUCKET_DIGITS)
    placed = every.withColumn("bucket", bucket)
    within = F.row_number().over(Window.partitionBy(*keys, "bucket").orderBy("bank_id", "account"))
    sizes = placed.groupBy(*keys, "bucket").agg(F.count("*").alias("size"))
    # At most 16 ** BUCKET_DIGITS rows for each client.
    before = sizes.withColumn("offset", F.sum("size").over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("bucket")) - F.col("size")).drop("size")
    return placed.withColumn("k", within).join(closed(before), [*keys, "bucket"]).select(*keys, "bank_id", "account", (F.col("offset") + F.col("k") - 1).cast("long").alias("vertex"))


def scatter_gather(tx: DataFrame, keys: tuple = ()) -> DataFrame:
    """Both ends of every pair, once; the intermediaries aren't part of the result.

    The gated edges, a small part of the transfers, are kept for the steps that use them, as long as the result is.
    """
    c = counted(edges(tx, keys), keys)
    g = gated(c, qualifying_sources(c, keys=keys), keys).persist()
    x, y, sides = _pruned_sides(g, ENOUGH, keys)
    if sides:
        return _holding(blocks.paired(x, y, keys, sides, ENOUGH, ends_only=True).distinct(), g)
    p = pairs_pruned(g, keys=keys)
    ends = F.explode(F.array(F.struct(F.col("a_bank").alias("bank_id"), F.col("a_account").alias("account")), F.struct(F.col("b_bank").alias("bank_id"), F.col("b_account").alias("account"))))
    return _holding(p.select(*keys, ends.alias("e")).select(*keys, "e.bank_id", "e.account").distinct(), g)
