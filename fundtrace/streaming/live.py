"""Answers while clients still send: keyed state that survives restarts, and ends of clients that close it.

Rows of a client are dealt over SHARDS keys, so no client and no bank is one task's work. A key keeps its part of each bank's
largest dollar transfer (Q2) and of the count under a dollar (Q5); both are merged where they are read, as parts of any split can be. A client's end goes to all of its
keys and closes them: what arrives in a later batch is dropped, and a timer then removes all but the mark that the key is closed.

What changes in a batch is written to a folder of its own, which a replayed batch overwrites, so after any prefix of batches the folder says what the batch
queries say of the rows of that prefix.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from fundtrace.functions import reference_values as V
from fundtrace.functions.expressions import bank_id, is_usd
from fundtrace.operators.transfers import under_a_dollar
from fundtrace.operators.two_hop import EDGE, edges

SHARDS = 16
#: How long a closed key's values stay, in milliseconds between the times of batches.
KEEP_MS = 60_000
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PARTIAL = "client_id string, shard int, bank_id string, from_account string, amount double, row_number long, n long, final boolean"


class _Answers(StatefulProcessor):
    """One (client, shard)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._best = handle.getMapState("best", "bank_id string", "amount double, row_number long, from_account string")
        self._count = handle.getValueState("count", "n long")
        self._closed = handle.getValueState("closed", "closed boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if self._closed.exists():
            for _ in rows:  # late rows of a client that has ended
                pass
            return
        n, ended, changed, now = (self._count.get()[0] if self._count.exists() else 0), False, {}, 0
        for part in rows:
            ended |= bool(part["ended"].any())
            now = int(part["received"].iloc[0].timestamp() * 1000)
            n += int(part["under"].sum())
            usd = part[part["usd"].astype(bool)]
            first = usd.sort_values(["amount", "row_number", "from_account"], ascending=[False, True, True]).drop_duplicates("bank_id")
            for bank, *new in first[["bank_id", "amount", "row_number", "from_account"]].itertuples(index=False):
                old = changed.get(bank) or (tuple(self._best.getValue((bank,))) if self._best.containsKey((bank,)) else None)
                if old is None or (-new[0], new[1], new[2]) < (-old[0], old[1], old[2]):
                    changed[bank] = (float(new[0]), int(new[1]), new[2])
        for bank, best in changed.items():
            self._best.updateValue((bank,), best)
        self._count.update((n,))
        if ended:
            self._closed.update((True,))
            self._handle.registerTimer(now + KEEP_MS)
        client, shard = key
        out = [(client, shard, bank, account, amount, row, None, ended) for bank, (amount, row, account) in changed.items()]
        yield pd.DataFrame([*out, (client, shard, None, None, None, None, n, ended)], columns=[c.split()[0] for c in PARTIAL.split(", ")]).astype({"row_number": "Int64", "n": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._best.clear()
        self._count.clear()
        return iter(())

    def close(self) -> None:
        pass


def keep_state(spark: SparkSession) -> None:
    """State of several named values needs the RocksDB store; a session that has chosen a store keeps it."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) is None:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def _to_folder(folder: str):
    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")

    return put


def answer_live(transfers: DataFrame, ends: DataFrame, currencies: DataFrame, rates: DataFrame, folder: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Starts keeping Q2 and Q5 of each client; transfers (with client_id) and ends (client_id) are streams.

    Rows of the batch in which a client ends still count; those of later batches don't.
    """
    keep_state(transfers.sparkSession)
    rows = under_a_dollar(transfers, currencies, rates).select(
        "client_id", F.pmod(F.hash("from_account", "row_number"), F.lit(SHARDS)).alias("shard"), bank_id(F.col("from_bank")).alias("bank_id"),
        "from_account", "amount", "row_number", is_usd().alias("usd"), "under", F.lit(False).alias("ended"))
    no = F.lit(False)
    last = ends.select(
        "client_id", F.explode(F.sequence(F.lit(0), F.lit(SHARDS - 1))).alias("shard"), F.lit(None).cast("string").alias("bank_id"), F.lit(None).cast("string").alias("from_account"),
        F.lit(None).cast("double").alias("amount"), F.lit(None).cast("long").alias("row_number"), no.alias("usd"), no.alias("under"), F.lit(True).alias("ended"))
    # The time of a batch is its own event time: a replayed batch has the same, and no row is late by it.
    timed = rows.unionByName(last).withColumn("received", F.current_timestamp()).withWatermark("received", "0 seconds")
    answers = timed.groupBy("client_id", "shard").transformWithStateInPandas(_Answers(), PARTIAL, "update", "eventTime")
    return answers.writeStream.outputMode("update").foreachBatch(_to_folder(folder)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _latest(spark: SparkSession, folder: str) -> DataFrame:
    """The last written value of each part: a row for each client, shard and bank (null for the count)."""
    told = spark.read.schema(PARTIAL + ", batch_id long").parquet(folder)
    values = F.struct("from_account", "amount", "row_number", "n")
    return told.groupBy("client_id", "shard", "bank_id").agg(F.max_by(values, "batch_id").alias("v"), F.max("final").alias("final")).select("client_id", "shard", "bank_id", "v.*", "final")


def largest_so_far(spark: SparkSession, folder: str, directory: DataFrame | None = None) -> DataFrame:
    """Q2 of each client over the batches so far: client_id, bank_id, from_account, [bank_name,] amount_paid."""
    best = F.min_by(F.struct("from_account", "amount"), F.struct(-F.col("amount"), F.col("row_number"), F.col("from_account"))).alias("best")
    found = _latest(spark, folder).filter("bank_id IS NOT NULL").groupBy("client_id", "bank_id").agg(best).select("client_id", "bank_id", "best.from_account", F.col("best.amount").alias("amount_paid"))
    return found if directory is None else found.join(directory, "bank_id").select("client_id", "bank_id", "from_account", "bank_name", "amount_paid")


def counts_so_far(spark: SparkSession, folder: str) -> DataFrame:
    """Q5 of each client over the batches so far: client_id, count, final (the client has ended)."""
    parts = _latest(spark, folder).filter("bank_id IS NULL")
    return parts.groupBy("client_id").agg(F.sum("n").alias("count"), F.max("final").alias("final"))


class _Gate(StatefulProcessor):
    """One source account of a client: its edges are held until it has more than `above` different targets, then replayed; later ones pass."""

    def __init__(self, above: int) -> None:
        self._above = above

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._targets = handle.getMapState("targets", "bank string, account string", "seen boolean")  # at most above + 1
        self._held = handle.getListState("held", "bank string, account string")
        self._open = handle.getValueState("open", "open boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        def passed(targets) -> pd.DataFrame:
            out = pd.DataFrame(targets, columns=["dst_bank", "dst_account"])
            for name, value in zip(("client_id", "src_bank", "src_account"), key):
                out[name] = value
            return out[["client_id", *EDGE]]

        is_open = self._open.exists()
        known = None if is_open else set(map(tuple, self._targets.keys()))
        for part in rows:
            new = part[["dst_bank", "dst_account"]]
            if not is_open:
                for t in new.drop_duplicates().itertuples(index=False):
                    if len(known) > self._above:
                        break
                    if tuple(t) not in known:
                        known.add(tuple(t))
                        self._targets.updateValue(tuple(t), (True,))
                if len(known) <= self._above:
                    self._held.appendList([tuple(t) for t in new.itertuples(index=False)])
                    continue
                is_open = True
                self._open.update((True,))
                held = [tuple(t) for t in self._held.get()] if self._held.exists() else []
                if held:
                    yield passed(held)
                self._held.clear()
                self._targets.clear()
            yield passed([tuple(t) for t in new.itertuples(index=False)])

    def close(self) -> None:
        pass


def gated_live(transfers: DataFrame, folder: str, checkpoint: str, above: int = V.FAN_OUT_ABOVE, trigger: dict | None = None) -> StreamingQuery:
    """Starts writing the edges of Q4 (client_id and EDGE) whose source has qualified by now, each once.

    A source keeps above + 1 targets at most, and its edges only until it qualifies; then they are replayed.
    """
    keep_state(transfers.sparkSession)
    gate = edges(transfers, ("client_id",)).groupBy("client_id", "src_bank", "src_account").transformWithStateInPandas(
        _Gate(above), "client_id string, " + ", ".join(f"{c} string" for c in EDGE), "append", "none")
    return gate.writeStream.outputMode("append").foreachBatch(_to_folder(folder)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
