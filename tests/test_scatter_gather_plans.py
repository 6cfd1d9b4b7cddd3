"""What the plans of the two-hop pattern save: edges that can't reach six paths, capped sets, numbers that depend on nothing but the accounts."""

import random

from fundtrace.operators import compare, two_hop
from fundtrace.sources import adapter

EDGES = ", ".join(f"{c} string" for c in two_hop.EDGE)


def made(spark, rows):
    return spark.createDataFrame([("1", a, "1", b) for a, b in rows], EDGES)


def join_rows(first, second):
    x = first.groupBy("dst_bank", "dst_account").count().withColumnsRenamed({"dst_bank": "bank", "dst_account": "account", "count": "x"})
    y = second.groupBy("src_bank", "src_account").count().withColumnsRenamed({"src_bank": "bank", "src_account": "account", "count": "y"})
    return x.join(y, ["bank", "account"]).selectExpr("sum(x * y) AS n").first().n


def gated(e):
    c = two_hop.counted(e)
    return two_hop.gated(c, two_hop.qualifying_sources(c))


def test_pruning_makes_fewer_pairs_on_the_given_tables(spark):
    g = gated(two_hop.edges(adapter.transactions(spark, "/root/testdata/sf0.1"))).cache()
    first, second = two_hop.pruned(g)
    before, after = join_rows(g, g), join_rows(first, second)
    assert 0 < after < before
    g.unpersist()


def test_pruned_pairs_equal_all_pairs(spark):
    r = random.Random(4)
    rows = [(f"v{int(r.random() ** 2 * 40)}", f"v{int(r.random() ** 2 * 40)}") for _ in range(700)] + [("a", "m")] * 3 + [("m", "b")] * 2 + [(s, f"{s}{i}") for s in "am" for i in range(6)]
    g = gated(made(spark, rows))
    want = two_hop.pairs(two_hop.two_hop_paths(g))
    assert compare.difference(want.drop("n_paths"), two_hop.pairs_pruned(g).drop("n_paths")).count() == 0 and want.count() > 20
    assert two_hop.pairs_pruned(g).select("n_paths").distinct().first().n_paths == 6
    # Every intermediary in a grid of blocks.
    assert compare.difference(two_hop.pairs_pruned(g), two_hop.pairs_pruned(g, hot_pairs=0, grid=(2, 3))).count() == 0


def test_products_beyond_64_bits_do_not_overflow(spark):
    g = spark.createDataFrame([("1", "a", "1", "m", 2**62), ("1", "m", "1", "b", 2**62)], EDGES + ", n long")
    assert [tuple(x) for x in two_hop.pairs_pruned(g).collect()] == [("1", "a", "1", "b", 6)]


def test_capped_sets_stop_at_six_members_in_each_task(spark, monkeypatch):
    rows = [("hub", f"t{i}") for i in range(5000)] * 2 + [(f"s{i}", f"t{k}") for i in range(30) for k in range(i % 9)] + [("self", "self"), ("self", "x")]
    for kept in (500_000, 10):
        monkeypatch.setattr(two_hop, "KEPT_ROWS", kept)
        found = {r.src_account: r.n_targets for r in two_hop.capped_targets(made(spark, rows)).collect()}
        assert found == {"hub": 6, "self": 2} | {f"s{i}": min(6, i % 9) for i in range(30) if i % 9}
    e = made(spark, rows)
    want = two_hop.qualifying_sources(two_hop.counted(e)).drop("n_targets")
    assert compare.difference(want, two_hop.qualifying_capped(e)).count() == 0 and two_hop.capped_targets(made(spark, [])).count() == 0


def test_numbers_of_accounts_have_no_gaps_whatever_the_partitions(spark):
    rows = [(f"v{i}", f"w{i % 70}") for i in range(500)]
    numbers = {(r.bank_id, r.account): r.vertex for r in two_hop.vertices(made(spark, rows)).collect()}
    assert sorted(numbers.values()) == list(range(570))
    again = {(r.bank_id, r.account): r.vertex for r in two_hop.vertices(made(spark, rows[::-1]).repartition(7)).collect()}
    assert numbers == again and two_hop.vertices(made(spark, [])).count() == 0
