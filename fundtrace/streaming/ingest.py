"""Incremental ingestion: files of a client's folder are staged exactly once and queried when the client is done."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundtrace.functions.expressions import stripped
from fundtrace.sources import csv_files
from fundtrace.streaming import partials

TRANSFER_SCHEMA = "row_number long, ts string, from_bank string, from_account string, to_bank string, to_account string, amount double, currency string, fmt string"


FINISHED, ABORTED = "_FINISHED", "_ABORTED"
#: The two files of a client, and the marks that they are closed.
TRANSACTIONS, ACCOUNTS = "transactions", "accounts"
#: Files of a batch that have numbers of their own.
BATCH_FILES = 1 << 20


def _marker(spark: SparkSession, staging: str, client: str, kind: str):
    """A marker of the client as a Hadoop path, and its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{staging}/{kind}-{client}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def finish(spark: SparkSession, staging: str, client: str) -> None:
    """The client's input is complete: its results may be computed, and what arrives later is ignored."""
    fs, path = _marker(spark, staging, client, FINISHED)
    fs.create(path, True).close()


def _marked(spark: SparkSession, staging: str, client: str, kind: str) -> bool:
    fs, path = _marker(spark, staging, client, kind)
    return fs.exists(path)


def is_finished(spark: SparkSession, staging: str, client: str) -> bool:
    return _marked(spark, staging, client, FINISHED)


def is_aborted(spark: SparkSession, staging: str, client: str) -> bool:
    return _marked(spark, staging, client, ABORTED)


def abort(spark: SparkSession, staging: str, client: str) -> None:
    """Marks the client, so that no batch of it is taken any more, and ends its stream if this session runs it."""
    fs, path = _marker(spark, staging, client, ABORTED)
    fs.create(path, True).close()
    for q in spark.streams.active:
        if q.name in (f"client-{client}", f"client-{client}-accounts"):
            q.stop()


def close(spark: SparkSession, staging: str, client: str, file: str) -> None:
    """The client has sent all of `file` (TRANSACTIONS or ACCOUNTS)."""
    fs, path = _marker(spark, staging, client, f"_CLOSED-{file}")
    fs.create(path, True).close()


def open_files(spark: SparkSession, staging: str, client: str) -> list[str]:
    return [f for f in (TRANSACTIONS, ACCOUNTS) if not _marked(spark, staging, client, f"_CLOSED-{f}")]


def _cleaned(tx: DataFrame) -> DataFrame:
    """Texts without white space at their ends, as windows and keys compare them."""
    return tx.withColumns({c: stripped(F.col(c)) for c in csv_files.MAX_BYTES if c in tx.columns})


def _stream(spark: SparkSession, put, source: str, checkpoint: str, name: str, max_files: int, schema: str | None) -> None:
    reader = spark.readStream.option("maxFilesPerTrigger", max_files)
    stream = reader.option("lineSep", "\n").text(source).select("value", "_metadata") if schema is None else reader.schema(schema).parquet(source)
    query = stream.writeStream.queryName(name).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def stage(spark: SparkSession, source: str, staging: str, checkpoint: str, client: str, schema: str = TRANSFER_SCHEMA, max_files: int = 100, kind: str = "parquet") -> None:
    """Takes what is new in `source` (Parquet files, or CSV files with a header each) to staging/client_id=/batch_id=, and its partial
    results beside it.

    A batch that is replayed after a crash overwrites its own folders, so each file counts once. After finish()
    or abort() nothing is taken any more, not even by a batch that has begun. CSV files are parsed by their own headers,
    and a bad row fails the batch. Files count in the order of batches, then by name, then by line.
    """
    if is_finished(spark, staging, client) or is_aborted(spark, staging, client):
        return

    def put(batch: DataFrame, batch_id: int) -> None:
        if kind == "csv":
            lines, headers = csv_files.numbered(batch)
            if not headers:
                return
            batch = csv_files.parsed(lines, headers, first_file=batch_id * BATCH_FILES)
        if not is_aborted(spark, staging, client):
            path = f"{staging}/client_id={client}/batch_id={batch_id}"
            _cleaned(batch).write.mode("overwrite").parquet(path)
            partials.write(spark.read.parquet(path), partials_folder(staging, client), batch_id)

    _stream(spark, put, source, checkpoint, f"client-{client}", max_files, None if kind == "csv" else schema)


def partials_folder(staging: str, client: str) -> str:
    return f"{staging}/_partials/client_id={client}"


def stage_accounts(spark: SparkSession, source: str, staging: str, checkpoint: str, client: str, max_files: int = 100) -> None:
    """The client's second stream: what is new among its account files goes to staging/_accounts/client_id=/batch_id=."""
    if is_finished(spark, staging, client) or is_aborted(spark, staging, client):
        return

    def put(batch: DataFrame, batch_id: int) -> None:
        lines, headers = csv_files.numbered(batch)
        if headers and not is_aborted(spark, staging, client):
            csv_files.parsed_accounts(lines, headers).write.mode("overwrite").parquet(f"{staging}/_accounts/client_id={client}/batch_id={batch_id}")

    _stream(spark, put, source, checkpoint, f"client-{client}-accounts", max_files, None)


def staged_accounts(spark: SparkSession, staging: str, client: str) -> DataFrame:
    """(bank_id, bank_name), once each, over all batches."""
    folder = f"{staging}/_accounts/client_id={client}"
    return spark.read.schema("bank_id string, bank_name string, batch_id long").option("basePath", folder).parquet(folder).select("bank_id", "bank_name").distinct()


def staged(spark: SparkSession, staging: str, client: str) -> DataFrame:
    return spark.read.option("basePath", staging).parquet(f"{staging}/client_id={client}").drop("batch_id")


def unique_messages(messages: DataFrame, keys: tuple, event_time: str, delay: str) -> DataFrame:
    """Redelivered messages of a stream go; state is kept for `delay` beyond the newest event."""
    return messages.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))


def running_count(messages: DataFrame, event_time: str, window: str, delay: str) -> DataFrame:
    """Live counts by event-time window and type; later than `delay` is left out."""
    return messages.withWatermark(event_time, delay).groupBy(F.window(event_time, window), "event_type").agg(F.count("*").alias("n"))
