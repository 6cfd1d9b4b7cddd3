"""Order-independent comparison of two results."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundtrace.functions.expressions import stripped
from fundtrace.operators.sinks import two_decimals


def normalized(df: DataFrame, amounts: tuple = ()) -> DataFrame:
    return df.select(*[two_decimals(F.col(f"`{c}`").cast("double")).alias(c) if c in amounts else stripped(F.col(f"`{c}`").cast("string")).alias(c) for c in df.columns])


def difference(expected: DataFrame, actual: DataFrame, amounts: tuple = ()) -> DataFrame:
    """Rows that only one side has, with `side` (missing or extra), each as often as it is too many."""
    a, b = normalized(expected, amounts), normalized(actual.select(*[f"`{c}`" for c in expected.columns]), amounts)
    return a.exceptAll(b).withColumn("side", F.lit("missing")).unionByName(b.exceptAll(a).withColumn("side", F.lit("extra")))
