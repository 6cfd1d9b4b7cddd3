"""Transfers and a bank directory derived from the star-schema Parquet tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The same text serves Spark and, with its string type replaced, an SQL oracle.
TRANSACTIONS_SQL = """
SELECT l_orderkey * 8 + l_linenumber AS row_number,
       CASE WHEN l_orderkey % 97 = 0 THEN day_part
            ELSE concat(day_part, ' ', lpad(CAST(l_partkey % 24 AS {text}), 2, '0'), ':', lpad(CAST(l_suppkey % 60 AS {text}), 2, '0')) END AS ts,
       lpad(CAST(fa % 25 AS {text}), 3, '0') AS from_bank, concat('A', CAST(fa AS {text})) AS from_account,
       lpad(CAST(ta % 25 AS {text}), 3, '0') AS to_bank, concat('A', CAST(ta AS {text})) AS to_account,
       l_extendedprice / (CASE l_linenumber % 7 WHEN 0 THEN 1.0e0 WHEN 1 THEN 1.0e1 WHEN 2 THEN 1.0e2 WHEN 3 THEN 1.0e3
                          WHEN 4 THEN 1.0e4 WHEN 5 THEN 1.0e5 ELSE 1.0e6 END) AS amount,
       CASE l_suppkey % 8 WHEN 3 THEN 'Euro' WHEN 4 THEN 'Yen' WHEN 5 THEN 'Bitcoin' WHEN 6 THEN 'Ruble' WHEN 7 THEN 'Yuan'
            ELSE 'US Dollar' END AS currency,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'Wire' WHEN '2-HIGH' THEN 'ACH' WHEN '3-MEDIUM' THEN 'Cheque'
            WHEN '4-NOT SPECIFIED' THEN 'Credit Card' ELSE 'Reinvestment' END AS fmt
FROM (SELECT l.*, o_orderpriority,
             concat('2022/09/', lpad(CAST(1 + (l_orderkey * 7 + l_linenumber) % 18 AS {text}), 2, '0')) AS day_part,
             CAST(floor((l_orderkey * 7919 % 10007) * (l_orderkey * 7919 % 10007) * n / 100140049) AS BIGINT) AS fa,
             CAST(floor((l_partkey * 4729 % 10007) * (l_partkey * 4729 % 10007) * n / 100140049) AS BIGINT) AS ta
      FROM lineitem l JOIN orders ON l_orderkey = o_orderkey CROSS JOIN (SELECT CAST(count(*) AS BIGINT) AS n FROM customer))
"""

ACCOUNTS_SQL = """
SELECT lpad(CAST(s_nationkey AS {text}), 2, '0') AS bank_id,
       concat(n_name, CASE WHEN s_suppkey % 3 = 0 THEN ' Trust' ELSE '' END) AS bank_name
FROM supplier JOIN nation ON s_nationkey = n_nationkey
"""


def _run(spark: SparkSession, sf_dir: str, sql: str, tables: list[str]) -> DataFrame:
    return spark.sql(
        sql.format(text="STRING", **{t: "{" + t + "}" for t in tables}),
        **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables},
    )


def _bound(sql: str, tables: list[str]) -> str:
    """Table names as parameters of spark.sql, so that no temporary view is left behind."""
    for t in tables:
        for word in ("FROM", "JOIN"):
            sql = sql.replace(f"{word} {t}", f"{word} {{{t}}}")
    return sql


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = ["lineitem", "orders", "customer"]
    return _run(spark, sf_dir, _bound(TRANSACTIONS_SQL, tables), tables)


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = ["supplier", "nation"]
    return _run(spark, sf_dir, _bound(ACCOUNTS_SQL, tables), tables)


def bank_directory(accounts_df: DataFrame) -> DataFrame:
    from fundtrace.functions.expressions import bank_id

    return (
        accounts_df.select(bank_id(F.col("bank_id")).alias("bank_id"), F.coalesce(F.trim("bank_name"), F.lit("")).alias("bank_name"))
        .filter("bank_id != ''").distinct()
    )
