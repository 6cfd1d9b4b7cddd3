"""Partial results of each staged batch, merged when the client is done: finished queries don't read the transfers again.

Beside a batch of transfers lie, under the same batch id, its largest dollar transfer of each bank (Q2), sum and count of each format's baseline amounts
(Q3), its count under a dollar (Q5), and the candidates of Q3, a folder for each format, in order of amount. Any split into batches merges to the same
results. The averages of Q3 are closed once, when the client's input is complete; each format's candidates are then read once with its bound
as a literal, by which Parquet skips row groups.
"""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundtrace.functions import reference_values as V
from fundtrace.functions.expressions import bank_id, in_text_window, is_usd
from fundtrace.operators import transfers as X
from fundtrace.sources import rates as R

#: Formats up to which candidates are read one format after the other; beyond, they are joined with the averages.
MOST_FORMATS = 64
PARTIALS = {
    "q2": "bank_id string, from_account string, amount double, file_number long, row_number long",
    "q3": "fmt string, total double, n long",
    "q5": "n long",
    "q3_candidates": "from_bank string, from_account string, amount double, fmt string",
}


def _best(*value: str) -> F.Column:
    return F.min_by(F.struct(*value), F.struct(-F.col("amount"), "file_number", "row_number", "from_account"))


def partials(tx: DataFrame, rates: DataFrame | None = None) -> dict[str, DataFrame]:
    """Q2, Q3 and Q5 of one batch, as what `merged` takes."""
    spark = tx.sparkSession
    number = F.col("file_number") if "file_number" in tx.columns else F.lit(0).cast("long")
    kept = ("from_account", "amount", "file_number", "row_number")
    usd = tx.filter(is_usd()).withColumn("file_number", number)
    return {
        "q2": usd.groupBy(bank_id(F.col("from_bank")).alias("bank_id")).agg(_best(*kept).alias("b")).select("bank_id", "b.*"),
        "q3": usd.filter(in_text_window(V.BASELINE_WINDOW)).groupBy("fmt").agg(F.sum("amount").alias("total"), F.count("*").alias("n")),
        "q5": X.converted(tx, R.currencies(spark), R.rates(spark) if rates is None else rates).filter("usd_amount < 1").agg(F.count("*").alias("n")),
    }


def write(tx: DataFrame, folder: str, batch_id: int) -> None:
    """Partial results and candidates of a batch; a replayed batch overwrites its own."""
    for name, df in partials(tx).items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}/batch_id={batch_id}")
    found = X.candidates(tx).select("from_bank", "from_account", "amount", "fmt")
    found.sortWithinPartitions("fmt", "amount").write.mode("overwrite").partitionBy("fmt").parquet(f"{folder}/q3_candidates/batch_id={batch_id}")


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(PARTIALS[name] + ", batch_id long").option("basePath", f"{folder}/{name}").parquet(f"{folder}/{name}").drop("batch_id")


def merged(parts: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """q2: (bank_id, from_account, amount_paid); q3: (fmt, avg_amount), 0 of no rows; q5: (count)."""
    out = {}
    if "q2" in parts:
        out["q2"] = parts["q2"].groupBy("bank_id").agg(_best("from_account", "amount").alias("b")).select("bank_id", "b.from_account", F.col("b.amount").alias("amount_paid"))
    if "q3" in parts:
        total, n = F.sum("total"), F.sum("n")
        out["q3"] = parts["q3"].groupBy("fmt").agg(F.when(n > 0, total / n).otherwise(0.0).alias("avg_amount"))
    if "q5" in parts:
        out["q5"] = parts["q5"].agg(F.coalesce(F.sum("n"), F.lit(0)).alias("count"))
    return out


def close_averages(spark: SparkSession, folder: str) -> DataFrame:
    """The averages of a complete client, written the first time and only read afterwards."""
    path = f"{folder}/q3_averages"
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        merged({"q3": read(spark, folder, "q3")})["q3"].coalesce(1).write.mode("overwrite").parquet(path)
    return spark.read.schema("fmt string, avg_amount double").parquet(path)


def low_candidates(spark: SparkSession, folder: str, divisor: float = V.AVERAGE_DIVISOR) -> DataFrame:
    """Q3 from the staged candidates: (bank_id, from_account, fmt, amount_paid)."""
    averages = close_averages(spark, folder)
    staged = read(spark, folder, "q3_candidates")
    shown = lambda df: df.select(bank_id(F.col("from_bank")).alias("bank_id"), "from_account", "fmt", F.col("amount").alias("amount_paid"))
    known = averages.limit(MOST_FORMATS + 1).collect()
    if len(known) > MOST_FORMATS:
        return shown(staged.join(averages, "fmt").filter(F.col("amount") < F.col("avg_amount") / divisor))
    each = [staged.filter((F.col("fmt") == r.fmt) & (F.col("amount") < r.avg_amount / divisor)) for r in known]
    return shown(reduce(DataFrame.unionByName, each) if each else staged.limit(0))
