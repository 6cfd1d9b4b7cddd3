"""Where operators cut lineage, and broadcast of bounded bit sets."""

import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a temporary folder only where none is set and all tasks run in this process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-fundtrace-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df as a Parquet table in the shared folder; what reads it needs none of its lineage."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str, **metrics) -> tuple[DataFrame, dict[str, int]]:
    """written(df), its number of rows (n) and other aggregates, all from the one job that writes it."""
    seen = Observation()
    table = written(df.observe(seen, F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in metrics.items()]), name)
    return table, seen.get


def key_slots(keys: np.ndarray, bits: int) -> np.ndarray:
    """Slots of 64-bit hashes, which are their own random bits."""
    return (keys.astype(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def hash_bit_set(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """A Bloom filter with one hash: 2 ** bits bits, whatever the number of rows; the column holds 64-bit hashes.

    At most 2 ** (bits - 6) rows reach the driver. With many values it fills up and filters less; results
    stay the same, as what passes it is checked by a join or a count.
    """
    slot = F.expr(f"shiftrightunsigned({column}, {64 - bits})")
    rows = (
        df.select(slot.alias("s")).groupBy(F.expr("shiftright(s, 6)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, CAST(s % 64 AS INT)))").alias("b"))
        .toPandas()
    )
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows["w"].to_numpy(np.int64)] = rows["b"].to_numpy(np.int64).view(np.uint64)
    return out


def held(words: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    s = key_slots(keys, bits)
    return (words[s >> 6] >> (s & 63).astype(np.uint64)) & np.uint64(1) == 1


#: Rows up to which a table of ids is broadcast.
FEW_IDS = 300_000


def checked_broadcast(ids: DataFrame, n: int | None = None) -> DataFrame:
    """ids with a broadcast hint if they are counted to be few, else without one, for a shuffled join; n: at least their number, if known."""
    return F.broadcast(ids) if (ids.limit(FEW_IDS + 1).count() if n is None else n) <= FEW_IDS else ids


#: Keys up to which rows are picked by a broadcast filter.
FEW_KEYS = 4_000_000


#: Bytes of an Arrow batch that goes to Python, unless the session has its own setting.
BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df; its session cuts what goes to Python by bytes, so texts of some KB don't fill both sides' memory ten thousand at a time."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def _give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: What a Python worker keeps from task to task, by the module whose functions use it.
KEPT: dict[str, dict] = {}


def _forget_others(module: str) -> None:
    for owner, kept in KEPT.items():
        if owner != module:
            kept.clear()


def thrifty(run):
    """run, a function of Arrow batches, that gives memory back to the system when its task ends: a worker outlives it.

    What other modules have kept in the worker goes before it begins. Spark keeps as many workers as were ever busy at once in
    an executor, so two of these functions should not follow each other without a shuffle or a written table between them.
    """
    module = run.__module__

    def wrapped(batches):
        _forget_others(module)
        try:
            yield from run(batches)
        finally:
            _give_back()

    return wrapped


def with_keys(rows: DataFrame, keys: DataFrame, n: int, column: str, bits: int, run, schema: str) -> DataFrame:
    """run, a function of Arrow batches, over the rows whose column (a 64-bit hash) is among the n keys, and perhaps some others.

    Few keys are broadcast as a filter of 2 ** bits bits, many are joined, so the filter never fills up. Filter and run share a worker.
    """
    if n > FEW_KEYS:
        return rows.join(keys.select(column).distinct(), column, "left_semi").mapInArrow(thrifty(run), schema)
    words = rows.sparkSession.sparkContext.broadcast(hash_bit_set(keys, column, bits))

    def asked(batches):
        for b in batches:
            m = held(words.value, b.column(column).to_numpy().view(np.uint64), bits)
            if m.any():
                yield b.filter(pa.array(m))

    return rows.mapInArrow(thrifty(lambda batches: run(asked(batches))), schema)


def thrifty_group(run):
    """run, a function of pandas frames, that gives memory back to the system after each group."""
    module = run.__module__

    def wrapped(*frames: pd.DataFrame) -> pd.DataFrame:
        _forget_others(module)
        try:
            return run(*frames)
        finally:
            _give_back()

    # Spark tells functions with and without a key by their number of arguments.
    n = run.__code__.co_argcount
    return (lambda a: wrapped(a)) if n == 1 else (lambda a, b: wrapped(a, b))
