"""Exchange rates and currency names as small tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundtrace.functions import reference_values as V
from fundtrace.operators.transfers import small_side


def rates(spark: SparkSession, cached: DataFrame | None = None) -> DataFrame:
    """(date, iso, rate): the fixed table laid over `cached`, whose other days and codes stay. It is broadcast where it is small, as the fixed rows are."""
    fixed = _inline(spark, "date, iso, rate", [f"('{d}', '{c}', {r!r}D)" for d, row in V.DAILY_RATES.items() for c, r in zip(V.RATE_CODES, row)])
    if cached is None:
        return F.broadcast(fixed)
    return small_side(
        cached.select("date", "iso", F.col("rate").alias("old")).join(fixed, ["date", "iso"], "full")
        .select("date", "iso", F.coalesce("rate", "old").alias("rate"))
    )


def _inline(spark: SparkSession, names: str, rows: list[str]) -> DataFrame:
    """A table within the plan: neither a job nor a Python worker makes it."""
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t({names})")


def currencies(spark: SparkSession) -> DataFrame:
    return _inline(spark, "currency, iso", [f"('{name}', '{code}')" for name, code in V.CURRENCY_ISO.items()])


def read_rates(spark: SparkSession, path: str) -> DataFrame:
    """(date, iso, rate) from a JSON file {date: {iso: rate}}, as rate services cache them."""
    days = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,map<string,double>>")).alias("date", "rates"))
    return days.select("date", F.explode("rates").alias("iso", "rate"))
