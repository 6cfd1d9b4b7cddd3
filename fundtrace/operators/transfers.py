"""Filters, aggregates and lookups on transfers (columns: row_number, ts, from_bank, from_account, to_bank,
to_account, amount, currency, fmt; `keys` adds e.g. client_id when several clients share a table)."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundtrace.functions import reference_values as V
from fundtrace.functions.expressions import bank_id, day, in_conversion_days, in_text_window, is_usd, is_wire_or_ach

#: A lookup side is broadcast only up to this many rows.
MAX_BROADCAST_ROWS = 100_000


def small_side(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it's seen to be small, else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS else df


def normalized_banks(tx: DataFrame) -> DataFrame:
    raw = tx.select(F.col("from_bank").alias("raw_bank")).union(tx.select("to_bank")).distinct()
    return raw.select("raw_bank", bank_id(F.col("raw_bank")).alias("bank_id"))


def small_usd(tx: DataFrame, below: float = V.SMALL_AMOUNT, keys: tuple = ()) -> DataFrame:
    """Dollar transfers under the amount, with bank ids as they were given."""
    return tx.filter(is_usd() & (F.col("amount") < below)).select(
        *keys, "from_bank", "from_account", "to_bank", "to_account", F.col("amount").alias("amount_paid"))


def in_order(tx: DataFrame) -> list[Column]:
    """What orders rows as they were sent: the file, where there are several, then the line."""
    return [F.col(c) for c in ("file_number", "row_number") if c in tx.columns]


def largest_per_bank(tx: DataFrame, keys: tuple = ()) -> DataFrame:
    """The largest dollar transfer of each sending bank; of equal ones the earliest row, then the first account."""
    best = F.min_by(F.struct("from_account", "amount"), F.struct(-F.col("amount"), *in_order(tx), F.col("from_account")))
    return (
        tx.filter(is_usd()).groupBy(*keys, bank_id(F.col("from_bank")).alias("bank_id")).agg(best.alias("best"))
        .select(*keys, "bank_id", "best.from_account", F.col("best.amount").alias("amount_paid"))
    )


def largest_per_bank_ranked(tx: DataFrame) -> DataFrame:
    """The same by a ranking window, as a cross-check; it sorts all rows of a bank."""
    w = Window.partitionBy("bank_id").orderBy(F.desc("amount"), *in_order(tx), "from_account")
    return (
        tx.filter(is_usd()).withColumn("bank_id", bank_id(F.col("from_bank"))).withColumn("rank", F.row_number().over(w))
        .filter("rank = 1").select("bank_id", "from_account", F.col("amount").alias("amount_paid"))
    )


def largest_with_names(tx: DataFrame, directory: DataFrame, keys: tuple = ()) -> DataFrame:
    """A bank with several names gives a row for each, one without a name gives none."""
    return largest_per_bank(tx, keys).join(directory, [*keys, "bank_id"]).select(*keys, "bank_id", "from_account", "bank_name", "amount_paid")


def average_by_format(tx: DataFrame, keys: tuple = ()) -> DataFrame:
    return tx.filter(is_usd() & in_text_window(V.BASELINE_WINDOW)).groupBy(*keys, "fmt").agg(F.avg("amount").alias("avg_amount"))


def candidates(tx: DataFrame) -> DataFrame:
    return tx.filter(is_usd() & in_text_window(V.CANDIDATE_WINDOW))


def closed(averages: DataFrame) -> DataFrame:
    """averages as rows that are computed once and broadcast, if they are seen to be few; else as they are, for a shuffled join."""
    rows = averages.limit(MAX_BROADCAST_ROWS + 1).toArrow()
    return F.broadcast(averages.sparkSession.createDataFrame(rows)) if len(rows) <= MAX_BROADCAST_ROWS else averages


def far_below_average(tx: DataFrame, divisor: float = V.AVERAGE_DIVISOR, keys: tuple = (), averages: DataFrame | None = None) -> DataFrame:
    """Dollar transfers of the candidate window under average / divisor of their payment format; the averages are of tx if not given.

    They are closed first, so candidates, of a handful of formats, aren't shuffled.
    """
    known = closed(average_by_format(tx, keys) if averages is None else averages)
    return (
        candidates(tx).join(known, [*keys, "fmt"]).filter(F.col("amount") < F.col("avg_amount") / divisor)
        .select(*keys, bank_id(F.col("from_bank")).alias("bank_id"), "from_account", "fmt", F.col("amount").alias("amount_paid"))
    )


def converted(tx: DataFrame, currencies: DataFrame, rates: DataFrame) -> DataFrame:
    """Wire and ACH transfers of the conversion days with usd_amount; without a rate a row goes."""
    looked_up = (
        tx.filter(is_wire_or_ach() & in_conversion_days()).withColumn("date", day())
        .join(F.broadcast(currencies), "currency").join(rates, ["date", "iso"])
    )
    return looked_up.select(*tx.columns, _in_dollars().alias("usd_amount"))


def _in_dollars() -> Column:
    return F.when(is_usd(), F.col("amount")).otherwise(F.col("amount") * (F.lit(1.0) / F.col("rate")))


def under_a_dollar(tx: DataFrame, currencies: DataFrame, rates: DataFrame) -> DataFrame:
    """tx with `under`: whether the fifth query counts the row."""
    looked_up = tx.withColumn("date", day()).join(F.broadcast(currencies), "currency", "left").join(rates, ["date", "iso"], "left")
    counts = is_wire_or_ach() & in_conversion_days() & F.col("rate").isNotNull() & (_in_dollars() < 1)
    return looked_up.select(*tx.columns, F.coalesce(counts, F.lit(False)).alias("under"))


def rates_in_use(tx: DataFrame, currencies: DataFrame, rates: DataFrame) -> DataFrame:
    """(date, iso, n_transfers, rate): what conversion looks up for the transfers' days and currencies; the rate is null where it lacks one."""
    used = tx.groupBy(day().alias("date"), "currency").agg(F.count("*").alias("n")).join(F.broadcast(currencies), "currency")
    counts = used.groupBy("date", "iso").agg(F.sum("n").alias("n_transfers"))
    return counts.join(rates, ["date", "iso"], "left").select("date", "iso", "n_transfers", "rate")


def count_under_dollar(tx: DataFrame, currencies: DataFrame, rates: DataFrame, keys: tuple = (), clients: DataFrame | None = None) -> DataFrame:
    """How many converted transfers are under a dollar; 0 where there are none, for each of `clients` (the keys found in tx if not given)."""
    counts = converted(tx, currencies, rates).filter("usd_amount < 1").groupBy(*keys).agg(F.count("*").alias("count"))
    if not keys:
        return counts
    every = (tx if clients is None else clients).select(*keys).distinct()
    return every.join(counts, list(keys), "left").select(*keys, F.coalesce("count", F.lit(0)).alias("count"))


def deduplicated(messages: DataFrame, keys: tuple) -> DataFrame:
    """One row per message identity, however often it was delivered."""
    return messages.dropDuplicates(list(keys))
