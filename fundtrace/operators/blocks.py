"""First hops times second hops as sparse matrices, over a grid of blocks, so that edges are shuffled and paths never are.

A block has the first hops of some sources and the second hops of some targets, and so every path between them: its sums are
final. Edges meet by intermediary first, where each task numbers its intermediaries; packed with these numbers, they go once to each
block of their row or column. The edges of one source and of one target to or from all intermediaries are in one block whole.
"""

import pickle

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edges that a task packs at a time, products that it makes at a time, and pairs in a batch of results.
PACKED, PRODUCTS, BATCH = 200_000, 1_000_000, 50_000


def paired(first: DataFrame, second: DataFrame, keys: tuple, grid: tuple[int, int], enough: int = 1, ends_only: bool = False) -> DataFrame:
    """(keys, a_bank, a_account, b_bank, b_account, n_paths) of pairs of different ends with `enough` paths, sums of n1 * n2.

    ends_only: (keys, bank_id, account), the ends of these pairs, each at least once. The caller sees to it that sums stay below 2 ** 62.
    """
    m = ["m_bank", "m_account"]
    hops = [
        d.filter("m_bank IS NOT NULL AND m_account IS NOT NULL").select(
            *keys, *m, F.lit(side).alias("side"), F.col(f"{x}_bank").alias("bank"), F.col(f"{x}_account").alias("account"), F.col(f"n{side + 1}").alias("n"),
            F.pmod(F.hash(f"{x}_bank", f"{x}_account"), F.lit(grid[side])).alias("block"))
        for side, (d, x) in enumerate(((first, "a"), (second, "b")))
    ]
    key_types = [f"`{f.name}` {f.dataType.simpleString()}" for f in first.select(*keys).schema] if keys else []
    met = hops[0].unionByName(hops[1]).repartition(*keys, *m).sortWithinPartitions(*keys, *m[::-1])
    packed = met.mapInArrow(_packer(list(keys), PACKED), ", ".join([*key_types, "side int", "block int", "edges binary"]))
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("side") == 0, F.lit(grid[1])).otherwise(F.lit(grid[0])) - 1))
    dealt = packed.withColumn("other", other).select(
        *keys, F.expr("if(side = 0, block, other)").alias("a_block"), F.expr("if(side = 0, other, block)").alias("b_block"), "side", "edges")
    tasks = max(grid[0] * grid[1], int(first.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    place = F.pmod(F.hash(*keys) if keys else F.lit(0), F.lit(tasks)) + F.col("a_block") * grid[1] + F.col("b_block")
    gathered = dealt.repartitionById(tasks, F.pmod(place, F.lit(tasks)).cast("int")).sortWithinPartitions(*keys, "a_block", "b_block")
    columns = ["bank_id string", "account string"] if ends_only else [*(f"{c} string" for c in ("a_bank", "a_account", "b_bank", "b_account")), "n_paths bigint"]
    return gathered.mapInArrow(_multiplier(list(keys), enough, ends_only, PRODUCTS, BATCH), ", ".join([*key_types, *columns]))


# What tasks run is nested, so that it travels by value.


def _packer(keys: list, most: int):
    def codes(column):
        return np.asarray(column.combine_chunks().dictionary_encode(null_encoding="encode").indices, dtype=np.int64)

    def small(x):
        return x.astype(np.min_scalar_type(int(x.max(initial=0))))

    def run(batches):
        first_number = TaskContext.get().partitionId() << 40
        last, numbered = None, 0

        def packed(held):
            nonlocal last, numbered
            t = pa.Table.from_batches(held)
            middle = [codes(t[c]) for c in (*keys, "m_bank", "m_account")]
            changed = np.zeros(len(t), bool)
            for c in middle:
                changed[1:] |= c[1:] != c[:-1]
            names = [tuple(t[c][k].as_py() for c in (*keys, "m_bank", "m_account")) for k in (0, len(t) - 1)]
            changed[0] = names[0] != last
            at = np.cumsum(changed) + numbered
            last, numbered = names[1], int(at[-1])
            side, block = t["side"].to_numpy(), t["block"].to_numpy()
            # An intermediary that has all its rows here and lacks a side is part of no path.
            k = at - at[0]
            both = (np.bincount(k[side == 0], minlength=k[-1] + 1) > 0) & (np.bincount(k[side == 1], minlength=k[-1] + 1) > 0)
            both[[0, -1]] = True
            bank, account = codes(t["bank"]), codes(t["account"])
            end, n = bank * (account.max() + 1) + account, t["n"].to_numpy()
            group = np.zeros(len(t), np.int64)
            for c in (*middle[: len(keys)], side.astype(np.int64), block.astype(np.int64)):
                group = group * (c.max() + 1) + c
            rows = np.flatnonzero(both[k])
            rows = rows[np.argsort(group[rows], kind="stable")]
            heads, edges = [], []
            for part in np.split(rows, np.flatnonzero(np.diff(group[rows])) + 1):
                if len(part):
                    _, one, code = np.unique(end[part], return_index=True, return_inverse=True)
                    low, some = int(at[part].min()), pa.array(part[one])
                    name = [t[c].take(some).combine_chunks() for c in ("bank", "account")]
                    heads.append(part[0])
                    edges.append(pickle.dumps((first_number + low, small(at[part] - low), small(code), small(n[part]) if (n[part] != 1).any() else None, *name), 5))
            some = t.select([*keys, "side", "block"]).take(pa.array(heads, pa.int64())).append_column("edges", pa.array(edges, pa.binary()))
            yield from some.combine_chunks().to_batches()

        held, size = [], 0
        for b in batches:
            held, size = [*held, b], size + b.num_rows
            if size >= most:
                yield from packed(held)
                held, size = [], 0
        if size:
            yield from packed(held)

    return run


def _multiplier(keys: list, enough: int, ends_only: bool, most: int, batch: int):
    def merged(parts):
        """Intermediaries, codes of ends, multiplicities, and the ends' banks and accounts."""
        bank, account = (pa.concat_arrays([p[k] for p in parts]) for k in (4, 5))
        code = [np.asarray(x.dictionary_encode(null_encoding="encode").indices, dtype=np.int64) for x in (bank, account)]
        _, one, known = np.unique(code[0] * (code[1].max() + 1) + code[1], return_index=True, return_inverse=True)
        offsets = np.cumsum([0, *(len(p[4]) for p in parts)])
        m = np.concatenate([p[0] + p[1].astype(np.int64) for p in parts])
        end = np.concatenate([known[o + p[2].astype(np.int64)] for p, o in zip(parts, offsets)])
        n = None if all(p[3] is None for p in parts) else np.concatenate([np.ones(len(p[1]), np.int64) if p[3] is None else p[3].astype(np.int64) for p in parts])
        one = pa.array(one)
        return m, end, n, bank.take(one), account.take(one)

    def common(x, y):
        """Codes of the names in x and in y, -1 for null."""
        both = pa.concat_arrays([x, y]).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        return both[: len(x)], both[len(x) :]

    def sums(cells, products, weights):
        """Occupied cells and their sums."""
        if weights is None or int(weights.max()) * len(weights) < 2**53:
            if cells <= 4 * len(products):
                total = np.bincount(products, weights, cells)
                at = np.flatnonzero(total)
                return at, total[at].astype(np.int64)
        order = np.argsort(products, kind="stable")
        products = products[order]
        begin = np.flatnonzero(np.diff(products, prepend=-1))
        return products[begin], np.diff(begin, append=len(products)) if weights is None else np.add.reduceat(weights[order], begin)

    def multiplied(first, second):
        """(a, b, paths) of the block's pairs with enough paths, piece by piece, as codes of ends."""
        (m1, a, n1, *x), (m2, b, n2, *y) = first, second
        order = np.argsort(m2, kind="stable")
        middles, start, degree = np.unique(m2[order], return_index=True, return_counts=True)
        b, n2 = b[order], None if n2 is None else n2[order]
        at = np.minimum(np.searchsorted(middles, m1), len(middles) - 1)
        rows = np.flatnonzero(middles[at] == m1)
        rows = rows[np.argsort(a[rows], kind="stable")]
        if not len(rows):
            return
        a, at, n1 = a[rows], at[rows], None if n1 is None else n1[rows]
        before = np.concatenate([[0], np.cumsum(degree[at])])
        heads = np.append(np.flatnonzero(np.diff(a, prepend=-1)), len(a))
        made = before[heads]
        (a_bank, b_bank), (a_account, b_account), ends = common(x[0], y[0]), common(x[1], y[1]), len(y[0])
        k = 0
        while k < len(heads) - 1:
            # As many sources as make no more products than that, one at least; one makes no more than the block has second hops.
            upto = max(k + 1, int(np.searchsorted(made, made[k] + most, "right")) - 1)
            i, j = heads[k], heads[upto]
            times = degree[at[i:j]]
            hop = np.repeat(start[at[i:j]] - (before[i:j] - before[i]), times) + np.arange(before[j] - before[i])
            cell = np.repeat(np.repeat(np.arange(upto - k), np.diff(heads[k : upto + 1])) * ends, times) + b[hop]
            weights = None
            if n1 is not None or n2 is not None:
                weights = (1 if n1 is None else np.repeat(n1[i:j], times)) * (1 if n2 is None else n2[hop])
            cell, paths = sums((upto - k) * ends, cell, weights)
            good = paths >= enough
            pa_, pb, paths = a[heads[k + cell[good] // ends]], cell[good] % ends, paths[good]
            other = (a_bank[pa_] != b_bank[pb]) & (a_bank[pa_] >= 0) & (b_bank[pb] >= 0) | (a_account[pa_] != b_account[pb]) & (a_account[pa_] >= 0) & (b_account[pb] >= 0)
            yield pa_[other], pb[other], paths[other]
            k = upto

    def answered(head, sides):
        if not (sides[0] and sides[1]):
            return
        first, second = merged(sides[0]), merged(sides[1])
        (a_bank, a_account), (b_bank, b_account) = first[3:], second[3:]

        def made(*columns):
            return pa.RecordBatch.from_arrays([*(pa.repeat(v, len(columns[0])) for v in head), *columns], names=names)

        if ends_only:
            names = [*keys, "bank_id", "account"]
            seen = np.zeros(len(a_bank), bool), np.zeros(len(b_bank), bool)
            for a, b, _ in multiplied(first, second):
                seen[0][a], seen[1][b] = True, True
            for some, bank, account in ((seen[0], a_bank, a_account), (seen[1], b_bank, b_account)):
                yield made(bank.filter(pa.array(some)), account.filter(pa.array(some)))
            return
        names = [*keys, "a_bank", "a_account", "b_bank", "b_account", "n_paths"]
        for a, b, paths in multiplied(first, second):
            for k in range(0, len(a), batch):
                x, y = pa.array(a[k : k + batch]), pa.array(b[k : k + batch])
                yield made(a_bank.take(x), a_account.take(x), b_bank.take(y), b_account.take(y), pa.array(paths[k : k + batch], pa.int64()))

    def run(batches):
        now, head, sides = None, [], ([], [])
        for b in batches:
            blocks = list(zip(*(b[c].to_pylist() for c in (*keys, "a_block", "b_block"))))
            for k, block in enumerate(blocks):
                if block != now:
                    yield from answered(head, sides)
                    now, head, sides = block, [b[c][k] for c in keys], ([], [])
                sides[b["side"][k].as_py()].append(pickle.loads(b["edges"][k].as_buffer()))
        yield from answered(head, sides)

    return run
