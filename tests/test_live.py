"""Live answers: after every batch as the batch queries over what has been taken, across restarts, and closed by a client's end."""

import pytest

from fundtrace.operators import compare, transfers, two_hop
from fundtrace.sources import rates
from fundtrace.streaming import ingest, live

SCHEMA = "client_id string, " + ingest.TRANSFER_SCHEMA


def rows(seed, client, n=60):
    import random

    r = random.Random(seed)
    return [(
        client, seed * 1000 + i, f"2022/09/0{r.randrange(1, 8)} 0{r.randrange(10)}:00", f"00{r.randrange(4)}", f"A{r.randrange(5)}", f"{r.randrange(3)}", f"B{r.randrange(9)}",
        r.choice([0.4, 1.0, 7.5, 20.0, 20.0]), r.choice(["US Dollar", "US Dollar", "Euro", "Yen", "Shells"]), r.choice(["Wire", "ACH", "Cheque"])) for i in range(n)]


class Session:
    def __init__(self, spark, tmp_path):
        self.spark, self.at = spark, {k: str(tmp_path / k) for k in ("in", "ends", "out", "ck", "gated", "gate_ck")}
        spark.createDataFrame([], SCHEMA).write.parquet(self.at["in"])
        spark.createDataFrame([], "client_id string").write.parquet(self.at["ends"])
        self.taken = []

    def send(self, part):
        self.spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(self.at["in"])

    def end(self, client):
        self.spark.createDataFrame([(client,)], "client_id string").coalesce(1).write.mode("append").parquet(self.at["ends"])

    def run(self):
        stream = self.spark.readStream.schema(SCHEMA).parquet(self.at["in"])
        ends = self.spark.readStream.schema("client_id string").parquet(self.at["ends"])
        live.answer_live(stream, ends, rates.currencies(self.spark), rates.rates(self.spark), self.at["out"], self.at["ck"]).awaitTermination()

    def same(self, counted):
        tx = self.spark.createDataFrame(counted, SCHEMA)
        names = self.spark.createDataFrame([("0", "Zero"), ("1", "One"), ("1", "Uno"), ("2", "Two")], "bank_id string, bank_name string")
        assert compare.difference(transfers.largest_per_bank(tx, ("client_id",)).join(names, "bank_id").select("client_id", "bank_id", "from_account", "bank_name", "amount_paid"), live.largest_so_far(self.spark, self.at["out"], names)).count() == 0
        want = transfers.count_under_dollar(tx, rates.currencies(self.spark), rates.rates(self.spark), ("client_id",))
        assert compare.difference(want, live.counts_so_far(self.spark, self.at["out"]).drop("final")).count() == 0


@pytest.fixture
def session(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live, "SHARDS", 2)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 2)
    yield Session(spark, tmp_path)
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_every_prefix_of_batches_equals_the_batch_queries_across_restarts(session):
    """Each run is a new query that goes on from the checkpoint; a run without input changes nothing."""
    taken = []
    for k in range(2):
        part = rows(k, "7") + rows(k + 50, "8", 20)
        session.send(part)
        taken += part
        session.run()
        session.same(taken)
    session.run()
    session.same(taken)


def test_rows_after_a_clients_end_are_dropped(session, monkeypatch):
    monkeypatch.setattr(live, "KEEP_MS", 0)
    first = rows(1, "7") + rows(2, "8")
    session.send(first)
    session.run()
    session.end("7")
    session.run()
    more = rows(3, "8")
    session.send(rows(4, "7") + more)  # late for client 7, whose timers have expired
    session.run()
    session.same(first + more)
    assert {(r.client_id, r.final) for r in live.counts_so_far(session.spark, session.at["out"]).collect()} == {("7", True), ("8", False)}


def test_replayed_batch_after_a_crash(session, tmp_path):
    """A run that dies after its output but before its commit is repeated from the state before."""
    first, second = rows(1, "7"), rows(2, "7")
    for part in (first, second):
        session.send(part)
        session.run()
    last = max((tmp_path / "ck/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    session.run()
    session.same(first + second)


def test_edges_are_held_until_their_source_qualifies(session):
    spark = session.spark
    edge = lambda i, a, b: ("7", i, "2022/09/01 00:00", "1", a, "2", b, 1.0, "US Dollar", "Wire")
    parts = [[edge(i, "A", f"t{i}") for i in range(4)] + [edge(50, "C", "t1")], [edge(10, "A", "t0"), edge(11, "A", "t8")], [edge(12, "A", "t9"), edge(13, "A", "t9"), edge(14, "D", "x")], [edge(15, "A", "t1")]]
    taken = []
    for part in parts:
        session.send(part)
        taken += part
        live.gated_live(spark.readStream.schema(SCHEMA).parquet(session.at["in"]), session.at["gated"], session.at["gate_ck"]).awaitTermination()
        e = two_hop.edges(spark.createDataFrame(taken, SCHEMA), ("client_id",))
        want = two_hop.gated(e, two_hop.qualifying_sources(two_hop.counted(e, ("client_id",)), keys=("client_id",)), ("client_id",))
        assert compare.difference(want, spark.read.schema("client_id string, " + ", ".join(f"{c} string" for c in two_hop.EDGE)).parquet(session.at["gated"])).count() == 0
    assert want.count() == 9
