"""Paths made in blocks of ends: the same rows as by joining, and no path is shuffled."""

import random

import pytest
from pyspark.sql import functions as F

from fundtrace.operators import blocks, compare, two_hop

EDGES = ", ".join(f"{c} string" for c in two_hop.EDGE)


def by_hand(rows, enough=1):
    """Pairs of different ends and their paths as SQL has them: rows of (client, source, target, n), an account being (bank, account)."""
    found = {}
    for k, a, m, n1 in rows:
        for k2, m2, b, n2 in rows:
            if k == k2 and m == m2 and None not in m and any(x is not None and y is not None and x != y for x, y in zip(a, b)):
                found[k, *a, *b] = found.get((k, *a, *b), 0) + n1 * n2
    return {k: v for k, v in found.items() if v >= enough}


def graph(spark, seed, most=3):
    r = random.Random(seed)
    name = lambda: (r.choice(["1", "2"]), f"v{int(r.random() ** 2 * 25)}")
    edges = {(r.choice("xy"), name(), name()): r.choice([1, 1, 2, most]) for _ in range(400)}
    edges |= {("x", ("1", "v0"), (None, "v1")): 1, ("x", (None, "v1"), ("1", "v3")): 2, ("x", ("1", "v0"), ("1", None)): 1, ("y", ("é|1", "a"), ("1", "v0")): 1}
    rows = [(k, a, b, n) for (k, a, b), n in edges.items()]
    return rows, spark.createDataFrame([(k, *a, *b, n) for k, a, b, n in rows], f"client_id string, {EDGES}, n long")


@pytest.mark.parametrize("grid,packed,products", [((1, 1), 200_000, 1_000_000), ((3, 2), 7, 5), ((2, 5), 50, 300)])
def test_blocks_equal_counting_by_hand(spark, monkeypatch, grid, packed, products):
    monkeypatch.setattr(blocks, "PACKED", packed)
    monkeypatch.setattr(blocks, "PRODUCTS", products)
    monkeypatch.setattr(blocks, "BATCH", 40)
    for seed, most in ((1, 1), (2, 3), (3, 2**29)):
        rows, g = graph(spark, seed, most)
        sides = two_hop._sides(g, ("client_id",))
        for enough in (1, 6):
            want = by_hand(rows, enough)
            got = [tuple(x) for x in blocks.paired(*sides, ("client_id",), grid, enough).collect()]
            assert len(got) == len(want) and {x[:-1]: x[-1] for x in got} == want
            ends = {tuple(x) for x in blocks.paired(*sides, ("client_id",), grid, enough, ends_only=True).collect()}
            assert ends == {(k[0], *k[i : i + 2]) for k in want for i in (1, 3)}
    assert blocks.paired(*two_hop._sides(g.limit(0), ()), (), grid).count() == 0


def test_many_paths_are_not_shuffled(spark, monkeypatch):
    """A dense graph, 60 x 60 x 60 paths: shuffled before, a row for each path, as the paths of a pair go over different accounts."""
    monkeypatch.setattr(two_hop, "FEW_PATHS", 1000)
    g = spark.range(3600).selectExpr("'1' src_bank", "string(id div 60) src_account", "'1' dst_bank", "string(id % 60) dst_account", "1L n").cache()
    found = {"paths": two_hop.two_hop_paths(g), "salted": two_hop.two_hop_salted(g), "pruned": two_hop.pairs_pruned(g), "pairs": two_hop.pairs(two_hop.two_hop_paths(g))}
    for name, df in found.items():
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString().partition("MapInArrow")[0] or name == "pruned"
        assert "mapInArrow" in df._jdf.queryExecution().optimizedPlan().toString().replace("MapInArrow", "mapInArrow")
        rows = df.agg(F.count("*").alias("rows"), F.min("n_paths").alias("least"), F.max("n_paths").alias("most")).first()
        assert tuple(rows) == (3540, 6, 6) if name == "pruned" else tuple(rows) == (3540, 60, 60)
    assert g.storageLevel.useMemory
    g.unpersist()


def test_the_way_depends_on_what_it_moves(spark, monkeypatch):
    g = spark.range(3600).selectExpr("'1' src_bank", "string(id div 60) src_account", "'1' dst_bank", "string(id % 60) dst_account", "1L n")
    sides = lambda: two_hop._sides_of_blocks(*two_hop._sides(g, ()), ())
    assert sides() is None
    monkeypatch.setattr(two_hop, "FEW_PATHS", 1000)
    assert sides() == (1, 1)
    monkeypatch.setattr(two_hop, "BLOCK_EDGES", 1000)
    assert sides() == (4, 4)
    monkeypatch.setattr(two_hop, "BLOCK_PATHS", 2160)
    assert sides() == (10, 10)
    monkeypatch.setattr(two_hop, "BLOCK_PATHS", 20)
    assert sides() is None
    huge = g.withColumn("n", F.lit(2**40))
    monkeypatch.setattr(two_hop, "BLOCK_PATHS", 2160)
    assert two_hop._sides_of_blocks(*two_hop._sides(huge, ()), ()) is None


def test_scatter_gather_in_blocks_equals_joining(spark, monkeypatch):
    r = random.Random(9)
    rows = [dict(k=r.choice("xy"), a=f"v{int(r.random() ** 2 * 60)}", b=f"v{int(r.random() ** 2 * 60)}") for _ in range(1500)]
    tx = spark.createDataFrame(rows).selectExpr("k AS client_id", "'01' AS from_bank", "a AS from_account", "'1' AS to_bank", "b AS to_account", "'US Dollar' AS currency", "'2022/09/02 10:00' AS ts").cache()
    for keys in ((), ("client_id",)):
        want = two_hop.scatter_gather(tx, keys).localCheckpoint()
        with monkeypatch.context() as m:
            m.setattr(two_hop, "FEW_PATHS", 10)
            m.setattr(two_hop, "BLOCK_EDGES", 400)
            got = two_hop.scatter_gather(tx, keys)
            assert "MapInArrow" in got._jdf.queryExecution().optimizedPlan().toString()
            assert compare.difference(want, got).count() == 0 and 20 < want.count()
