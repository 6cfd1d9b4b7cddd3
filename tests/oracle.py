"""Runs a query and its SQL side by side."""

import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows_of(df):
    names = sorted(df.columns)
    return Counter(tuple(r[n] for n in names) for r in df.collect())


def oracle_rows(con, sql):
    rel = con.sql(sql)
    order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    return sorted(rel.columns), Counter(tuple(r[i] for i in order) for r in rel.fetchall())


def same(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    names, want = oracle_rows(duck(sf_dir), sql)
    assert sorted(df.columns) == names
    got = rows_of(df)
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
    return sum(got.values())
