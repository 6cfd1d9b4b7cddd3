"""Registered queries on the star-schema tables, each with the SQL that must give the same rows."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundtrace.functions import reference_values as V
from fundtrace.functions.expressions import in_conversion_days, in_text_window, is_usd, is_wire_or_ach
from fundtrace.operators import transfers as X
from fundtrace.operators import two_hop as G
from fundtrace.sources import adapter as A
from fundtrace.sources import rates as R

COLUMNS = "row_number, ts, from_bank, from_account, to_bank, to_account, amount, currency, fmt"


def _tx(f):
    return lambda spark, d: f(A.transactions(spark, d))


def _filtered(condition):
    return lambda spark, d: A.transactions(spark, d).filter(condition())


def _directory(spark, d):
    return A.bank_directory(A.accounts(spark, d))


def _gated(tx):
    c = G.counted(G.edges(tx))
    return G.gated(c, G.qualifying_sources(c))


def _dedup(spark: SparkSession, d: str) -> DataFrame:
    events = spark.read.parquet(f"{d}/events.parquet")
    again = events.union(events.filter("event_id % 7 = 0"))
    return X.deduplicated(again, ("user_id", "event_id")).select("event_id", "user_id", "event_type", "value")


def queries() -> dict:
    return {
        "scan_transactions": _tx(lambda t: t),
        "bank_directory": _directory,
        "rates_table": lambda spark, d: X.rates_in_use(A.transactions(spark, d), R.currencies(spark), R.rates(spark)),
        "normalize_bank_id": _tx(X.normalized_banks),
        "filter_usd": _filtered(is_usd),
        "filter_wire_ach": _filtered(is_wire_or_ach),
        "q3_baseline_window": _filtered(lambda: in_text_window(V.BASELINE_WINDOW)),
        "q3_candidate_window": _filtered(lambda: in_text_window(V.CANDIDATE_WINDOW)),
        "q4_window": _filtered(lambda: in_text_window(V.BASELINE_WINDOW)),
        "filter_q5_window": _filtered(in_conversion_days),
        "q1_small_usd": _tx(X.small_usd),
        "q2_max_raw": _tx(X.largest_per_bank),
        "q2_max_window": _tx(X.largest_per_bank_ranked),
        "q2_max_per_bank": lambda spark, d: X.largest_with_names(A.transactions(spark, d), _directory(spark, d)),
        "q3_avg_by_format": _tx(lambda t: X.average_by_format(t).withColumn("avg_amount", F.round("avg_amount", 6))),
        "q3_low_vs_avg": _tx(X.far_below_average),
        "q4_edges": _tx(G.edges),
        "q4_qualifying_sources": _tx(lambda t: G.qualifying_sources(G.counted(G.edges(t)))),
        "q4_gated_edges": _tx(lambda t: G.gated(e := G.edges(t), G.qualifying_sources(G.counted(e)))),
        "q4_counted_edges": _tx(lambda t: G.counted(G.edges(t))),
        "q4_intermediaries": _tx(lambda t: G.intermediaries(_gated(t))),
        "q4_two_hop_paths": _tx(lambda t: G.two_hop_paths(_gated(t))),
        "q4_two_hop_salted": _tx(lambda t: G.two_hop_salted(_gated(t))),
        "q4_qualifying_capped": _tx(lambda t: G.qualifying_capped(G.edges(t))),
        "q4_vertices": _tx(lambda t: G.vertices(G.edges(t))),
        "q4_pairs_pruned": _tx(lambda t: G.pairs_pruned(_gated(t))),
        "q4_pairs": _tx(lambda t: G.pairs(G.two_hop_paths(_gated(t)))),
        "q4_scatter_gather": _tx(G.scatter_gather),
        "q5_converted_rows": lambda spark, d: X.converted(A.transactions(spark, d), R.currencies(spark), R.rates(spark)),
        "q5_count": lambda spark, d: X.count_under_dollar(A.transactions(spark, d), R.currencies(spark), R.rates(spark)),
        "q5_count_by_client": _tx(lambda t: X.count_under_dollar(t.withColumn("client_id", F.col("from_bank")), R.currencies(t.sparkSession), R.rates(t.sparkSession), ("client_id",))),
        "dedup_redelivery": _dedup,
    }


def oracle_sql() -> dict[str, str]:
    bank = lambda c: f"CASE WHEN regexp_matches(trim({c}), '^[0-9]+$') THEN coalesce(nullif(ltrim(trim({c}), '0'), ''), '0') ELSE trim({c}) END"
    rate_rows = ", ".join(f"('{d}', '{c}', {r!r}::DOUBLE)" for d, row in V.DAILY_RATES.items() for c, r in zip(V.RATE_CODES, row))
    iso_rows = ", ".join(f"('{n}', '{c}')" for n, c in V.CURRENCY_ISO.items())
    window = lambda w: f"ts BETWEEN '{w[0]}' AND '{w[1]}'"
    days = "replace(substr(ts, 1, 10), '/', '-')"
    parts = {
        "tx": A.TRANSACTIONS_SQL.format(text="VARCHAR"),
        "directory": f"SELECT DISTINCT {bank('bank_id')} AS bank_id, trim(bank_name) AS bank_name FROM ({A.ACCOUNTS_SQL.format(text='VARCHAR')})",
        "usd": "SELECT * FROM tx WHERE currency = 'US Dollar'",
        "best": f"SELECT bank_id, from_account, amount AS amount_paid FROM (SELECT *, {bank('from_bank')} AS bank_id, row_number() OVER (PARTITION BY {bank('from_bank')} ORDER BY amount DESC, row_number, from_account) AS k FROM usd) WHERE k = 1",
        "averages": f"SELECT fmt, avg(amount) AS avg_amount FROM usd WHERE {window(V.BASELINE_WINDOW)} GROUP BY fmt",
        "edges": f"SELECT {bank('from_bank')} AS src_bank, from_account AS src_account, {bank('to_bank')} AS dst_bank, to_account AS dst_account FROM usd WHERE {window(V.BASELINE_WINDOW)}",
        "sources": "SELECT src_bank AS bank_id, src_account AS account, count(DISTINCT (dst_bank, dst_account)) AS n_targets FROM edges GROUP BY ALL HAVING count(DISTINCT (dst_bank, dst_account)) > 5",
        "gated": "SELECT e.* FROM edges e SEMI JOIN sources s ON src_bank = bank_id AND src_account = account",
        "paths": "SELECT x.src_bank AS a_bank, x.src_account AS a_account, y.dst_bank AS b_bank, y.dst_account AS b_account, CAST(sum(x.n * y.n) AS BIGINT) AS n_paths FROM (SELECT *, count(*) AS n FROM gated GROUP BY ALL) x JOIN (SELECT *, count(*) AS n FROM gated GROUP BY ALL) y ON x.dst_bank = y.src_bank AND x.dst_account = y.src_account WHERE x.src_bank != y.dst_bank OR x.src_account != y.dst_account GROUP BY ALL",
        "converted": f"SELECT tx.*, CASE WHEN tx.currency = 'US Dollar' THEN amount ELSE amount * (1.0::DOUBLE / rate) END AS usd_amount FROM tx JOIN (VALUES {iso_rows}) c(currency, iso) ON tx.currency = c.currency JOIN (VALUES {rate_rows}) r(date, iso, rate) ON r.iso = c.iso AND r.date = {days} WHERE fmt IN ('Wire', 'ACH') AND {days} BETWEEN '{V.CONVERSION_DAYS[0]}' AND '{V.CONVERSION_DAYS[1]}'",
    }
    head = "WITH " + ", ".join(f"{k} AS ({v})" for k, v in parts.items()) + " "
    paths = "SELECT * FROM paths"
    bodies = {
        "scan_transactions": "SELECT * FROM tx",
        "bank_directory": "SELECT * FROM directory",
        "normalize_bank_id": f"SELECT DISTINCT raw_bank, {bank('raw_bank')} AS bank_id FROM (SELECT from_bank AS raw_bank FROM tx UNION SELECT to_bank FROM tx)",
        "filter_usd": "SELECT * FROM usd",
        "filter_wire_ach": "SELECT * FROM tx WHERE fmt IN ('Wire', 'ACH')",
        "q3_baseline_window": f"SELECT * FROM tx WHERE {window(V.BASELINE_WINDOW)}",
        "q3_candidate_window": f"SELECT * FROM tx WHERE {window(V.CANDIDATE_WINDOW)}",
        "q4_window": f"SELECT * FROM tx WHERE {window(V.BASELINE_WINDOW)}",
        "filter_q5_window": f"SELECT * FROM tx WHERE {days} BETWEEN '{V.CONVERSION_DAYS[0]}' AND '{V.CONVERSION_DAYS[1]}'",
        "q1_small_usd": "SELECT from_bank, from_account, to_bank, to_account, amount AS amount_paid FROM usd WHERE amount < 50",
        "q2_max_raw": "SELECT * FROM best",
        "q2_max_window": "SELECT * FROM best",
        "q2_max_per_bank": "SELECT bank_id, from_account, bank_name, amount_paid FROM best JOIN directory USING (bank_id)",
        "q3_avg_by_format": "SELECT fmt, round(avg_amount, 6) AS avg_amount FROM averages",
        "q3_low_vs_avg": f"SELECT {bank('from_bank')} AS bank_id, from_account, fmt, amount AS amount_paid FROM usd JOIN averages USING (fmt) WHERE {window(V.CANDIDATE_WINDOW)} AND amount < avg_amount / 100",
        "q4_edges": "SELECT * FROM edges",
        "q4_qualifying_sources": "SELECT * FROM sources",
        "q4_gated_edges": "SELECT * FROM gated",
        "q4_counted_edges": "SELECT *, count(*) AS n FROM edges GROUP BY ALL",
        "q4_intermediaries": "SELECT dst_bank AS bank_id, dst_account AS account FROM gated INTERSECT SELECT src_bank, src_account FROM gated",
        "q4_two_hop_paths": paths,
        "q4_two_hop_salted": paths,
        "q4_pairs": f"{paths} WHERE n_paths > 5",
        "q4_qualifying_capped": "SELECT bank_id, account FROM sources",
        "q4_vertices": "SELECT bank_id, account, row_number() OVER (ORDER BY substr(md5(bank_id || '|' || account), 1, 3), bank_id, account) - 1 AS vertex FROM (SELECT src_bank AS bank_id, src_account AS account FROM edges UNION SELECT dst_bank, dst_account FROM edges)",
        "q4_pairs_pruned": "SELECT * REPLACE (least(n_paths, 6) AS n_paths) FROM paths WHERE n_paths > 5",
        "q4_scatter_gather": "SELECT a_bank AS bank_id, a_account AS account FROM paths WHERE n_paths > 5 UNION SELECT b_bank, b_account FROM paths WHERE n_paths > 5",
        "q5_converted_rows": "SELECT * FROM converted",
        "q5_count": "SELECT count(*) AS count FROM converted WHERE usd_amount < 1",
        "q5_count_by_client": "SELECT c.client_id, count(v.usd_amount) AS count FROM (SELECT DISTINCT from_bank AS client_id FROM tx) c LEFT JOIN (SELECT * FROM converted WHERE usd_amount < 1) v ON v.from_bank = c.client_id GROUP BY c.client_id",
        "rates_table": f"SELECT u.date, u.iso, u.n_transfers, r.rate FROM (SELECT {days} AS date, iso, count(*) AS n_transfers FROM tx JOIN (VALUES {iso_rows}) c(currency, iso) ON tx.currency = c.currency GROUP BY ALL) u LEFT JOIN (VALUES {rate_rows}) r(date, iso, rate) ON r.date = u.date AND r.iso = u.iso",
    }
    return {k: head + v for k, v in bodies.items()} | {
        "dedup_redelivery": "SELECT DISTINCT event_id, user_id, event_type, value FROM (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 7 = 0)",
    }
