"""The boundary cases of the five queries, on inline rows."""

import pytest

from fundtrace.operators import compare, sinks, transfers, two_hop
from fundtrace.plans import session
from fundtrace.sources import csv_files, rates
from fundtrace.streaming import ingest

SCHEMA = ingest.TRANSFER_SCHEMA


def tx(spark, rows):
    out = []
    for i, r in enumerate(rows):
        d = dict(row_number=i + 2, ts="2022/09/01 00:00", from_bank="1", from_account="A", to_bank="2", to_account="B", amount=1.0, currency="US Dollar", fmt="Wire") | r
        out.append(tuple(d.values()))
    return spark.createDataFrame(out, SCHEMA)


def got(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_small_usd_is_strict_and_keeps_raw_banks(spark):
    t = tx(spark, [dict(amount=49.99, from_bank="001"), dict(amount=50.0), dict(amount=1.0, currency="Euro")])
    assert got(transfers.small_usd(t), "from_bank", "amount_paid") == [("001", 49.99)]


def test_largest_coerces_bank_and_needs_a_name(spark):
    t = tx(spark, [dict(from_bank="001", amount=100.0), dict(from_bank="001", from_account="lead", amount=200.0), dict(from_bank="1", amount=50.0), dict(from_bank="02", amount=300.0), dict(from_bank="3", amount=400.0, currency="Euro")])
    names = spark.createDataFrame([("1", "One"), ("1", "Uno"), ("3", "Three")], "bank_id string, bank_name string")
    assert got(transfers.largest_with_names(t, names), "bank_id", "from_account", "bank_name", "amount_paid") == [("1", "lead", "One", 200.0), ("1", "lead", "Uno", 200.0)]


def test_largest_tie_goes_to_the_earlier_row(spark):
    t = tx(spark, [dict(row_number=20, from_account="later", amount=100.0), dict(row_number=10, from_account="earlier", amount=100.0)])
    assert got(transfers.largest_per_bank(t), "from_account") == [("earlier",)]
    assert got(transfers.largest_per_bank_ranked(t), "from_account") == [("earlier",)]


def test_average_windows(spark):
    t = tx(spark, [dict(amount=100.0), dict(from_bank="2", ts="2022/09/06 00:00", amount=0.5), dict(from_bank="3", ts="2022/09/14 23:59", amount=0.7), dict(from_bank="4", ts="2022/09/15 00:00", amount=0.1), dict(from_bank="5", ts="2022/09/14 10:00", amount=1.0), dict(from_bank="6", ts="2022/09/10 10:00", amount=0.1, currency="Euro"), dict(from_bank="7", ts="2022/09/10 10:00", amount=0.1, fmt="Cheque")])
    assert got(transfers.far_below_average(t), "bank_id") == [("2",), ("3",)]


def test_bare_date_is_in_both_windows(spark):
    t = tx(spark, [dict(ts="2022/09/06", amount=0.001), dict(amount=1000.0)])
    assert got(transfers.average_by_format(t), "avg_amount") == [(500.0005,)]
    assert len(got(transfers.far_below_average(t), "bank_id")) == 1


def scatter(spark, hops):
    rows = []
    for a, m, n in hops:
        rows += [dict(from_account=a, from_bank="1", to_bank="1", to_account=m)] * n
    return tx(spark, rows)


def test_scatter_gather_needs_six_targets_at_both_hops(spark):
    fill = lambda s: [(s, f"{s}{i}", 1) for i in range(5)]
    good = [("A", "M", 1), *fill("A"), ("M", "B", 6), *fill("M")]
    few = [("C", "H", 1), *fill("C"), ("H", "D", 5), *fill("H")]
    ungated = [("X", "Y", 1), *fill("X"), ("Y", "Z", 9)]
    assert got(two_hop.scatter_gather(scatter(spark, good + few + ungated)), "account") == [("A",), ("B",)]


def test_self_transfer_counts_as_target_and_hop(spark):
    fill = [("A", f"a{i}", 1) for i in range(4)]
    t = scatter(spark, [("A", "A", 2), ("A", "B", 3), *fill])
    assert got(two_hop.scatter_gather(t), "account") == [("A",), ("B",)]


def test_salted_equals_plain(spark):
    g = two_hop.counted(two_hop.edges(scatter(spark, [("A1", "M", 2), ("A2", "M", 4), ("M", "B1", 3), ("M", "B2", 5), ("M", "A1", 1)])))
    plain, salted = two_hop.two_hop_paths(g), two_hop.two_hop_salted(g, 2, 3)
    assert compare.difference(plain, salted).count() == 0 and plain.count() > 0


def test_conversion(spark):
    t = tx(spark, [dict(amount=0.5), dict(amount=1.0, currency="Euro"), dict(amount=0.1, currency="Shells"), dict(amount=0.1, ts="2022/09/06 00:00"), dict(amount=0.1, fmt="Cheque"), dict(amount=0.1, currency="Danish Krone")])
    df = transfers.converted(t, rates.currencies(spark), rates.rates(spark))
    assert sorted(round(r.usd_amount, 4) for r in df.collect()) == [0.5, 0.9998]
    assert transfers.count_under_dollar(t, rates.currencies(spark), rates.rates(spark)).first()["count"] == 2


def test_rate_overlay(spark):
    cached = spark.createDataFrame([("2022-09-01", "EUR", 9.0), ("2022-09-01", "SEK", 10.0)], "date string, iso string, rate double")
    merged = {(r.date, r.iso): r.rate for r in rates.rates(spark, cached).collect()}
    assert merged[("2022-09-01", "EUR")] == 1.0002 and merged[("2022-09-01", "SEK")] == 10.0 and len(merged) == 76


def test_csv_by_header_name(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_bytes(b"Payment Format,From Bank,Account,To Bank,Account,Amount Paid,Payment Currency,Timestamp,Extra\r\nWire,001, A ,010,B,12.5,US Dollar,2022/09/01 00:00,x\r\nWire,1,A,2,,oops,US Dollar,2022/09/01 00:00,x\r\n")
    rows = csv_files.read_transactions(spark, str(p), "quarantine").orderBy("row_number").collect()
    assert rows[0].from_account == "A" and rows[0].to_account == "B" and rows[0].amount == 12.5 and rows[0].error is None
    assert rows[1].error == "empty to_account"
    with pytest.raises(Exception, match="bad row"):
        csv_files.read_transactions(spark, str(p)).collect()
    with pytest.raises(csv_files.BadInput):
        csv_files.transaction_positions(["Timestamp"])


def test_accounts_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("Bank Name,Bank ID,Other\n Raw One ,001,x\nRaw One,1,y\nNo Id,,z\n")
    assert got(csv_files.read_accounts(spark, str(p)), "bank_id", "bank_name") == [("1", "Raw One")]


def test_clients_are_isolated_and_abort_leaves_nothing(spark, tmp_path):
    names = spark.createDataFrame([("1", "One")], "bank_id string, bank_name string")
    for c, amount in (("7", 10.0), ("8", 20.005)):
        session.run_client(spark, c, tx(spark, [dict(amount=amount)]), names, str(tmp_path), ("q1", "q2"))
    read = lambda c: spark.read.option("header", True).csv(f"{tmp_path}/results_q1/client_id={c}").first()
    assert read("7")["Amount Paid"] == "10.00" and read("8")["Amount Paid"] == f"{20.005:.2f}"
    session.abort_client(spark, "7", [f"{tmp_path}/results_q1/client_id=7"])
    assert not (tmp_path / "results_q1/client_id=7").exists() and (tmp_path / "results_q1/client_id=8").exists()


def test_published_headers(spark):
    df = transfers.small_usd(tx(spark, [dict(amount=0.125)]))
    row = sinks.as_published("q1", df).collect()[0]
    assert list(row.asDict()) == sinks.HEADERS["q1"] and row["Amount Paid"] == "0.12"


def test_comparison_counts_repeats(spark):
    a = spark.createDataFrame([("x", 1.0), ("x", 1.0), ("y", 2.0)], "k string, v double")
    b = spark.createDataFrame([("y", 2.001), ("x", 1.0)], "k string, v double")
    assert compare.difference(a, a.orderBy("k"), ("v",)).count() == 0
    assert [(r.k, r.side) for r in compare.difference(a, b, ("v",)).collect()] == [("x", "missing")]


def test_staging_resumes_without_repeats(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    tx(spark, [dict(amount=1.0)]).write.parquet(src)
    ingest.stage(spark, src, out, ck, "1")
    ingest.stage(spark, src, out, ck, "1")
    tx(spark, [dict(amount=2.0)]).write.mode("append").parquet(src)
    ingest.stage(spark, src, out, ck, "1")
    assert sorted(r.amount for r in ingest.staged(spark, out, "1").collect()) == [1.0, 2.0]


def test_replayed_batch_after_a_crash(spark, tmp_path):
    """A run that dies after its output but before its commit is repeated under the same batch id."""
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    tx(spark, [dict(amount=1.0)]).write.parquet(src)
    ingest.stage(spark, src, out, ck, "1")
    for f in (tmp_path / "ck/commits").iterdir():
        f.unlink()
    ingest.stage(spark, src, out, ck, "1")
    assert ingest.staged(spark, out, "1").count() == 1


def test_stream_dedup(spark, tmp_path):
    src = str(tmp_path / "ev")
    spark.sql("SELECT id AS event_id, id % 3 AS user_id, timestamp'2024-01-01 00:00:00' AS ts FROM range(5) UNION ALL SELECT 0, 0, timestamp'2024-01-01 00:00:00'").write.parquet(src)
    stream = spark.readStream.schema("event_id long, user_id long, ts timestamp").parquet(src)
    q = ingest.unique_messages(stream, ("user_id", "event_id"), "ts", "1 hour").writeStream.format("memory").queryName("uniq").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("uniq").count() == 5


def test_late_files_of_a_finished_client_are_ignored(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    tx(spark, [dict(amount=1.0)]).write.parquet(src)
    ingest.stage(spark, src, out, ck, "1")
    ingest.finish(spark, out, "1")
    tx(spark, [dict(amount=2.0)]).write.mode("append").parquet(src)
    ingest.stage(spark, src, out, ck, "1")
    assert ingest.staged(spark, out, "1").count() == 1 and not ingest.is_finished(spark, out, "2")


def test_clients_in_one_table_equal_clients_apart(spark):
    from pyspark.sql import functions as F

    apart = {c: tx(spark, [dict(amount=10.0 * c), dict(amount=0.001, ts="2022/09/07 10:00"), dict(amount=0.5), dict(from_bank="2", amount=7.0)]) for c in (1, 2)}
    names = spark.createDataFrame([("1", "One"), ("2", "Two")], "bank_id string, bank_name string")
    together = apart[1].withColumn("client_id", F.lit(1)).union(apart[2].withColumn("client_id", F.lit(2)))
    both_names = names.crossJoin(spark.createDataFrame([(1,), (2,)], "client_id int"))
    joint = session.results(spark, together, both_names, keys=("client_id",))
    for c, t in apart.items():
        for q, df in session.results(spark, t, names).items():
            mine = joint[q].filter(F.col("client_id") == c).drop("client_id")
            assert compare.difference(df, mine).count() == 0, (c, q)


def test_enabled_queries(spark):
    names = spark.createDataFrame([("1", "One")], "bank_id string, bank_name string")
    assert list(session.results(spark, tx(spark, [{}]), names, ("q5", "q1"))) == ["q1", "q5"]
    with pytest.raises(ValueError):
        session.results(spark, tx(spark, [{}]), names, ("q9",))


def test_command_line(spark, tmp_path):
    from fundtrace.__main__ import main

    (tmp_path / "t.csv").write_text("Timestamp,From Bank,Account,To Bank,Account,Amount Paid,Payment Currency,Payment Format\n2022/09/01 00:00,001,A,2,B,12.5,US Dollar,Wire\n")
    (tmp_path / "a.csv").write_text("Bank ID,Bank Name\n1,One\n")
    paths = main([str(tmp_path / "t.csv"), str(tmp_path / "a.csv"), str(tmp_path / "out"), "--queries", "q1,q2,q5"])
    assert list(paths) == ["q1", "q2", "q5"]
    assert spark.read.option("header", True).csv(paths["q2"]).collect()[0].asDict() == {"From Bank": "1", "Account": "A", "Bank Name": "One", "Amount Paid": "12.50"}


def test_white_space_and_digits_of_any_script(spark):
    t = tx(spark, [dict(from_bank="\t007\u00a0", amount=1.0), dict(from_bank="\u0660\u0661", amount=2.0), dict(from_bank=" AB1\x1f", amount=3.0)])
    assert got(transfers.largest_per_bank(t), "bank_id") == [("1",), ("7",), ("AB1",)]


def test_client_without_a_match_counts_zero(spark):
    from pyspark.sql import functions as F

    t = tx(spark, [dict(amount=0.5)]).withColumn("client_id", F.lit(1)).union(tx(spark, [dict(amount=9.0)]).withColumn("client_id", F.lit(2)))
    assert got(transfers.count_under_dollar(t, rates.currencies(spark), rates.rates(spark), ("client_id",)), "client_id", "count") == [(1, 1), (2, 0)]
    more = spark.createDataFrame([(1,), (2,), (3,)], "client_id int")
    assert got(transfers.count_under_dollar(t, rates.currencies(spark), rates.rates(spark), ("client_id",), more), "client_id", "count") == [(1, 1), (2, 0), (3, 0)]


def test_two_decimals_as_printed(spark):
    values = [0.125, 1.005, 2.675, 0.375, 1234567.895, -0.001, 20.005]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r.s for r in df.select(sinks.two_decimals(df.v).alias("s")).collect()] == [f"{v:.2f}" for v in values]


def test_result_equals_what_was_written_and_read(spark, tmp_path):
    df = transfers.small_usd(tx(spark, [dict(amount=0.125), dict(amount=2.675)]))
    published = sinks.as_published("q1", df)
    path = sinks.write_expected("q1", df, str(tmp_path), "inline rows")
    assert compare.difference(sinks.read_result(spark, "q1", path), published, ("Amount Paid",)).count() == 0
    assert compare.difference(sinks.read_result(spark, "q1", path), sinks.as_published("q1", df.limit(1)), ("Amount Paid",)).count() == 1


HEAD = "Timestamp,From Bank,Account,To Bank,Account,Amount Paid,Payment Currency,Payment Format"


def test_each_file_has_its_own_header_and_place(spark, tmp_path):
    (tmp_path / "b.csv").write_text(HEAD + "\n2022/09/01 00:00,3,third,2,B,1,US Dollar,Wire\n")
    (tmp_path / "a.csv").write_text("Payment Format,From Bank,Account,To Bank,Account,Amount Paid,Payment Currency,Timestamp\r\nWire,1,first,2,B,1,US Dollar,2022/09/01 00:00\r\nWire,2,second,2,B,1,US Dollar,2022/09/01 00:00\r\n")
    rows = csv_files.read_transactions(spark, str(tmp_path)).orderBy("row_number").collect()
    assert sorted((r.file_number, r.row_number, r.from_account) for r in rows) == [(0, 2, "first"), (0, 3, "second"), (1, 2, "third")]


def test_csv_upload_gives_results_once_the_client_is_done(spark, tmp_path):
    src, out, ck = (tmp_path / x for x in ("in", "staging", "ck"))
    src.mkdir()
    (tmp_path / "accounts").mkdir()
    (tmp_path / "accounts/a.csv").write_text("Bank ID,Bank Name\n001,One\n")
    (src / "1.csv").write_text(HEAD + "\n2022/09/01 00:00,001,A,2,B,12.5,US Dollar,Wire\n")
    ingest.stage(spark, str(src), str(out), str(ck), "1", kind="csv")
    (src / "2.csv").write_text(HEAD + "\n2022/09/01 00:00,001,C,2,B,30,US Dollar,Wire\n")
    ingest.stage(spark, str(src), str(out), str(ck), "1", kind="csv")
    ingest.close(spark, str(out), "1", ingest.TRANSACTIONS)
    with pytest.raises(session.IncompleteUpload, match="accounts"):
        session.complete(spark, "1", str(out), str(tmp_path / "results"))
    ingest.close(spark, str(out), "1", ingest.ACCOUNTS)
    with pytest.raises(session.IncompleteUpload, match="no accounts"):
        session.complete(spark, "1", str(out), str(tmp_path / "results"))
    ingest.stage_accounts(spark, str(tmp_path / "accounts"), str(out), str(tmp_path / "ck2"), "1")
    paths = session.complete(spark, "1", str(out), str(tmp_path / "results"), ("q1", "q2"))
    assert paths["q2"].endswith("results_q2_1.csv") and open(paths["q2"]).read() == "From Bank,Account,Bank Name,Amount Paid\n1,C,One,30.00\n"
    assert spark.read.option("header", True).csv(paths["q2"]).first()["Account"] == "C"
    assert spark.read.option("header", True).csv(paths["q1"]).count() == 2
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None


def test_abort_of_a_client_that_is_sending(spark, tmp_path):
    """Its stream ends, nothing of it is left, and what it sends later is ignored."""
    import threading
    import time

    src, out, ck = (tmp_path / x for x in ("in", "staging", "ck"))
    for k in range(40):
        tx(spark, [dict(amount=float(k))]).coalesce(1).write.mode("append").parquet(str(src))
    sender = threading.Thread(target=lambda: ingest.stage(spark, str(src), str(out), str(ck), "5", max_files=1), daemon=True)
    sender.start()
    while not (out / "client_id=5").exists():
        time.sleep(0.1)
    session.abort_client(spark, "5", [str(ck)], str(out))
    sender.join(60)
    assert not sender.is_alive() and not (out / "client_id=5").exists() and not ck.exists()
    ingest.stage(spark, str(src), str(out), str(ck), "5")
    assert not (out / "client_id=5").exists()


def test_hot_intermediary_is_dealt_by_its_measured_size(spark):
    rows = [dict(from_account=f"A{i}", to_account="M", to_bank="1") for i in range(8)] + [dict(from_account="M", to_account=f"B{i}", to_bank="1") for i in range(9)] + [dict(from_account="A1", to_account="N", to_bank="1"), dict(from_account="N", to_account="B1", to_bank="1")]
    g = two_hop.counted(two_hop.edges(tx(spark, rows)))
    assert got(two_hop.hot_intermediaries(g, 70), "m_account") == [("M",)] and two_hop.hot_intermediaries(g, 72).isEmpty()
    assert compare.difference(two_hop.two_hop_paths(g), two_hop.two_hop_paths(g, hot_pairs=70)).count() == 0


def test_cached_rates_from_a_file(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"2022-09-01": {"SEK": 10.5, "EUR": 9.0}}')
    merged = {(r.date, r.iso): r.rate for r in rates.rates(spark, rates.read_rates(spark, str(tmp_path / "r.json"))).collect()}
    assert merged["2022-09-01", "SEK"] == 10.5 and merged["2022-09-01", "EUR"] == 1.0002
