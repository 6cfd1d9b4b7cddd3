"""Several clients side by side: the same queries with client_id in every key, or one job group per client."""

from pyspark.sql import DataFrame, SparkSession

from fundtrace.functions.expressions import is_usd
from fundtrace.operators import transfers, two_hop
from fundtrace.operators.sinks import publish, write_result
from fundtrace.sources import csv_files
from fundtrace.sources import rates as R
from fundtrace.streaming import ingest, partials

QUERIES = ("q1", "q2", "q3", "q4", "q5")


class IncompleteUpload(ValueError):
    """A client's results are asked for before it has sent everything."""


def results(spark: SparkSession, tx: DataFrame, directory: DataFrame, enabled=QUERIES, keys: tuple = (), folder: str | None = None) -> dict[str, DataFrame]:
    """The enabled queries' results; a query that isn't enabled costs nothing.

    folder: the partial results of one client's batches; with them Q2, Q3 and Q5 are merged and don't read tx.
    """
    unknown = set(enabled) - set(QUERIES)
    if unknown:
        raise ValueError(f"unknown queries {sorted(unknown)}")
    usd = tx.filter(is_usd())
    plans = {
        "q1": lambda: transfers.small_usd(usd, keys=keys),
        "q2": lambda: transfers.largest_with_names(usd, directory, keys),
        "q3": lambda: transfers.far_below_average(usd, keys=keys),
        "q4": lambda: two_hop.scatter_gather(usd, keys),
        "q5": lambda: transfers.count_under_dollar(tx, R.currencies(spark), R.rates(spark), keys),
    }
    if folder is not None:
        part = lambda name: partials.merged({name: partials.read(spark, folder, name)})[name]
        plans |= {
            "q2": lambda: part("q2").join(directory, "bank_id").select("bank_id", "from_account", "bank_name", "amount_paid"),
            "q3": lambda: partials.low_candidates(spark, folder), "q5": lambda: part("q5"),
        }
    return {q: plans[q]() for q in QUERIES if q in enabled}


def run_client(spark: SparkSession, client: str, tx: DataFrame, directory: DataFrame, out_dir: str, enabled=QUERIES, folder: str | None = None, write=write_result) -> dict[str, str]:
    """Writes one client's results under its own job group, which this thread leaves at the end; rows parsed once serve all queries.

    folder: see results; write: write_result for a folder of parts, publish for one file each.
    """
    sc = spark.sparkContext
    before = {k: sc.getLocalProperty(k) for k in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")}
    sc.setJobGroup(f"client-{client}", f"queries of client {client}", interruptOnCancel=True)
    shared = tx.persist()
    try:
        return {q: write(q, df, out_dir, client) for q, df in results(spark, shared, directory, enabled, folder=folder).items()}
    finally:
        shared.unpersist()
        for k, v in before.items():
            sc.setLocalProperty(k, v)


def complete(spark: SparkSession, client: str, staging: str, out_dir: str, enabled=QUERIES, write=publish) -> dict[str, str]:
    """The client has sent both files: what is staged is final, and its results are written. Q1 and Q4 read the staged transfers, the others partial results.

    Raises IncompleteUpload while one of its files isn't closed, or nothing of it is staged.
    """
    if still := ingest.open_files(spark, staging, client):
        raise IncompleteUpload(f"client {client} hasn't closed {' and '.join(still)}")
    for name, folder in ((ingest.TRANSACTIONS, f"{staging}/client_id={client}"), (ingest.ACCOUNTS, f"{staging}/_accounts/client_id={client}")):
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            raise IncompleteUpload(f"client {client} has sent no {name}")
    ingest.finish(spark, staging, client)
    tx, directory = ingest.staged(spark, staging, client), ingest.staged_accounts(spark, staging, client)
    return run_client(spark, client, tx, directory, out_dir, enabled, ingest.partials_folder(staging, client), write)


def run_upload(spark: SparkSession, client: str, source: str, sizes: dict[str, int], out_dir: str, enabled=QUERIES, write=publish) -> dict[str, str]:
    """Results of an upload in chunks: folders source/transactions and source/accounts of files `name@offset`; sizes: the bytes of each whole file.

    Raises IncompleteUpload if bytes are missing or there twice. Lines that chunks break are put together.
    """
    conf = spark._jsc.hadoopConfiguration()
    for name in (ingest.TRANSACTIONS, ingest.ACCOUNTS):
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{source}/{name}")
        fs = at.getFileSystem(conf)
        chunks = sorted((int(s.getPath().getName().rpartition("@")[2]), s.getLen()) for s in fs.listStatus(at) if "@" in s.getPath().getName()) if fs.exists(at) else []
        end = 0
        for offset, length in chunks:
            if offset != end:
                raise IncompleteUpload(f"client {client}: {name} has a chunk at {offset}, expected {end}")
            end = offset + length
        if end != sizes.get(name):
            raise IncompleteUpload(f"client {client}: {name} has {end} bytes, expected {sizes.get(name)}")
    tx, directory = csv_files.read_transactions(spark, f"{source}/{ingest.TRANSACTIONS}"), csv_files.read_accounts(spark, f"{source}/{ingest.ACCOUNTS}")
    return run_client(spark, client, tx, directory, out_dir, enabled, write=write)


def abort_client(spark: SparkSession, client: str, folders: list[str], staging: str | None = None) -> None:
    """Ends the client's stream and jobs, so nothing writes any more, and then deletes its folders; other clients aren't touched.

    In `staging` the client is marked first: what it still sends is ignored.
    """
    if staging is not None:
        ingest.abort(spark, staging, client)
        folders = [*folders, f"{staging}/client_id={client}", f"{staging}/_accounts/client_id={client}", ingest.partials_folder(staging, client)]
    spark.sparkContext.cancelJobGroup(f"client-{client}")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for f in folders:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(conf).delete(path, True)
