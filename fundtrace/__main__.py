"""python -m fundtrace TRANSACTIONS.csv ACCOUNTS.csv OUT [--queries q1,q3] [--client ID] [--partitions N]"""

import argparse

from pyspark.sql import SparkSession

from fundtrace.plans import session
from fundtrace.sources import csv_files


def main(args: list[str] | None = None) -> dict[str, str]:
    p = argparse.ArgumentParser(prog="fundtrace")
    p.add_argument("transactions")
    p.add_argument("accounts")
    p.add_argument("out")
    p.add_argument("--queries", default=",".join(session.QUERIES))
    p.add_argument("--client", default="0")
    p.add_argument("--partitions", type=int)
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("fundtrace").getOrCreate()
    if a.partitions:
        spark.conf.set("spark.sql.shuffle.partitions", a.partitions)
    tx, names = csv_files.read_transactions(spark, a.transactions), csv_files.read_accounts(spark, a.accounts)
    return session.run_client(spark, a.client, tx, names, a.out, tuple(a.queries.split(",")))


if __name__ == "__main__":
    for query, path in main().items():
        print(query, path)
