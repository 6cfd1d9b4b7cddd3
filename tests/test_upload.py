"""Uploads and CSV files: hostile rows against a row-at-a-time oracle, line numbers, chunks, partial results of batches, published files."""

import csv
import io
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fundtrace.functions import reference_values as V
from fundtrace.operators import compare, sinks, transfers
from fundtrace.plans import session
from fundtrace.sources import csv_files, rates
from fundtrace.streaming import ingest, partials

HEAD = "Timestamp,From Bank,Account,To Bank,Account,Amount Paid,Payment Currency,Payment Format"


def line(ts="2022/09/01 00:00", a_bank="1", a="A", b_bank="2", b="B", amount="1", currency="US Dollar", fmt="Wire"):
    return f"{ts},{a_bank},{a},{b_bank},{b},{amount},{currency},{fmt}"


def bank(raw):
    text = raw.strip()
    return str(int(text)) if text.isdecimal() else text


def good_rows(text):
    """What a reader with csv and float takes; None for a bad row."""
    lines = text.split("\n")
    lines = lines[:-1] if lines[-1] == "" else lines
    header = next(csv.reader([lines[0].rstrip("\r")]))
    for number, raw in enumerate(lines[1:], 2):
        raw = raw[:-1] if raw.endswith("\r") else raw
        cells = next(csv.reader([raw]), [])
        try:
            if len(cells) != len(header):
                raise ValueError
            at = header.index("From Bank"), header.index("To Bank")
            names = {"ts": header.index("Timestamp"), "from_bank": at[0], "from_account": header.index("Account", at[0]), "to_bank": at[1], "to_account": header.index("Account", at[1]),
                     "amount": header.index("Amount Paid"), "currency": header.index("Payment Currency"), "fmt": header.index("Payment Format")}
            row = {k: cells[i].strip() for k, i in names.items()}
            if not all(row.values()) or any(len(row[k].encode()) > w for k, w in csv_files.MAX_BYTES.items()):
                raise ValueError
            row["amount"] = float(row["amount"])
            if not math.isfinite(row["amount"]):
                raise ValueError
        except ValueError:
            row = None
        yield number, row


def answers(rows, accounts):
    """Q1 to Q5 one row at a time."""
    names = defaultdict(set)
    for cells in list(csv.reader(io.StringIO(accounts)))[1:]:
        if len(cells) >= 2 and bank(cells[0]):
            names[bank(cells[0])].add(cells[1].strip())
    out, best, totals, low, edges = {"q1": [], "q2": [], "q3": [], "q4": [], "q5": 0}, {}, defaultdict(list), [], defaultdict(int)
    for r in rows:
        if r["currency"] == "US Dollar":
            if r["amount"] < 50:
                out["q1"].append((r["from_bank"], r["from_account"], r["to_bank"], r["to_account"], f"{r['amount']:.2f}"))
            if bank(r["from_bank"]) not in best or r["amount"] > best[bank(r["from_bank"])][1]:
                best[bank(r["from_bank"])] = (r["from_account"], r["amount"])
            if "2022/09/01" <= r["ts"] <= "2022/09/06":
                totals[r["fmt"]].append(r["amount"])
                edges[(bank(r["from_bank"]), r["from_account"]), (bank(r["to_bank"]), r["to_account"])] += 1
            if "2022/09/06" <= r["ts"] <= "2022/09/15":
                low.append(r)
        day, code = r["ts"][:10].replace("/", "-"), V.CURRENCY_ISO.get(r["currency"])
        if r["fmt"] in ("Wire", "ACH") and day in V.DAILY_RATES and code in V.RATE_CODES:
            rate = V.DAILY_RATES[day][V.RATE_CODES.index(code)]
            out["q5"] += (r["amount"] if code == "USD" else r["amount"] * (1 / rate)) < 1
    out["q2"] = [(b, a, n, f"{x:.2f}") for b, (a, x) in best.items() for n in names.get(b, ())]
    out["q3"] = [(bank(r["from_bank"]), r["from_account"], r["fmt"], f"{r['amount']:.2f}") for r in low if r["fmt"] in totals and r["amount"] < sum(totals[r["fmt"]]) / len(totals[r["fmt"]]) / 100]
    targets = defaultdict(set)
    for a, b in edges:
        targets[a].add(b)
    gate = {a for a, t in targets.items() if len(t) > 5}
    paths = defaultdict(int)
    for (a, m), n in edges.items():
        if a in gate and m in gate:
            for b in targets[m]:
                if a != b:
                    paths[a, b] += n * edges[m, b]
    out["q4"] = sorted({x for pair, n in paths.items() if n > 5 for x in pair})
    return out


def hostile(seed):
    """A transactions file with reordered columns, quotes, odd numbers, bad rows and ties, and an accounts file."""
    r = random.Random(seed)
    names = ["Timestamp", "From Bank", "Account", "To Bank", "Account", "Amount Paid", "Payment Currency", "Payment Format", "Extra"]
    if r.random() < 0.5:
        names = ["Payment Format", "Extra", "From Bank", "Account", "To Bank", "Account", "Timestamp", "Payment Currency", "Amount Paid"]
    rows = []
    for _ in range(r.randrange(60, 120)):
        amount = r.choice(["12.5", "49.999", "50", "7e-3", ".5", "5.", "1_000", "+3", "1d", "1f", "nan", "inf", "x", "٣", "", " 2.675 ", "0x1", "1e400", "-1", "900000", "0.004"])
        account = lambda: r.choice(["A", "M", "N", *[f"T{i}" for i in range(7)], 'x ""y"" z', "a,b", " p ", " q"])
        value = {"Timestamp": f"2022/09/{r.randrange(1, 17):02d}" + r.choice(["", " 00:00", " 13:45"]), "From Bank": r.choice(["1", "001", "010", "AB", "٣", " 2"]), "To Bank": r.choice(["1", "01", "2", "7"]),
                 "Amount Paid": amount, "Payment Currency": r.choice(["US Dollar"] * 6 + ["Euro", "Yen", "Shells"]), "Payment Format": r.choice(["Wire", "ACH", "Cheque"]), "Extra": r.choice(["", "e", '"q"'])}
        cells = []
        for n in names:
            v = account() if n == "Account" else value[n]
            quoted = '"' in v or "," in v or r.random() < 0.1
            cells.append('"' + (v if '""' in v else v.replace('"', '""')) + '"' + r.choice(["", "", "", "t"] if n == "Extra" else [""]) if quoted else v)
        if r.random() < 0.04:
            cells = cells[:-1] if r.random() < 0.5 else [*cells, "more"]
        rows.append(",".join(cells) if r.random() > 0.02 else "")
    for s in ("A", "M"):
        rows += [",".join({"Timestamp": "2022/09/02", "From Bank": "1", "Account": None, "To Bank": "1", "Amount Paid": "3", "Payment Currency": "US Dollar", "Payment Format": "Wire", "Extra": ""}.get(n) or ((s, f"T{i}")[names[:k].count("Account")] if n == "Account" else "") for k, n in enumerate(names)) for i in range(6)]
    rows += [rows[-1].replace("T5", "M").replace(",M,1,M", ",A,1,M")] * r.randrange(0, 7)
    end = r.choice(["\n", "\r\n"])
    accounts = ["Bank ID,Bank Name,Other", "001, One ,x", "1,Uno", "2,", "2", "", "AB,\"A \"\"b\"\", c\"", ",none", "3,Three,", "٣,Drei"]
    return ",".join(names) + end + end.join(rows) + r.choice(["", end]), "\n".join(accounts) + "\n"


SEEDS = 50


def test_hostile_files_equal_the_oracle(spark, tmp_path):
    """One client for each seed; the rows that are kept, the bad ones and all five queries."""
    (tmp_path / "t").mkdir()
    want, bad, kept = {}, set(), {}
    for seed in range(SEEDS):
        text, accounts = hostile(seed)
        (tmp_path / f"t/{seed:03d}.csv").write_bytes(text.encode())
        rows = list(good_rows(text))
        bad |= {(seed, n) for n, row in rows if row is None}
        kept |= {(seed, n): tuple(row[k] for k in csv_files.TRANSACTION_FIELDS) for n, row in rows if row is not None}
        want[seed] = answers([row for _, row in rows if row is not None], accounts)
    (tmp_path / "a.csv").write_text(accounts)
    read = csv_files.read_transactions(spark, str(tmp_path / "t"), "quarantine").cache()
    found = {(r.file_number, r.row_number): tuple(r[k] for k in csv_files.TRANSACTION_FIELDS) if r.error is None else None for r in read.collect()}
    assert {k for k, v in found.items() if v is None} == bad and {k: v for k, v in found.items() if v is not None} == kept and len(bad) > SEEDS and len(kept) > 50 * SEEDS
    tx = read.filter("error IS NULL").withColumn("client_id", F.col("file_number"))
    names = csv_files.read_accounts(spark, str(tmp_path / "a.csv")).join(spark.range(SEEDS).withColumnRenamed("id", "client_id"))
    for q, df in session.results(spark, tx, names, keys=("client_id",)).items():
        got = defaultdict(list)
        for r in df.withColumn("amount_paid", sinks.two_decimals(F.col("amount_paid"))).collect() if "amount_paid" in df.columns else df.collect():
            got[r.client_id].append(tuple(r[c] for c in df.columns if c != "client_id"))
        for seed in range(SEEDS):
            mine = want[seed][q]
            assert sorted(got[seed]) == (sorted(mine) if q != "q5" else [(mine,)]), (q, seed)
    assert sum(len(w["q4"]) for w in want.values()) > 10
    read.unpersist()


def test_faults_are_named_by_file_and_line(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text(HEAD + "\n" + line() + "\n" + line(amount="1d") + "\n")
    with pytest.raises(Exception, match=r"bad row: amount isn't a finite number in .*t\.csv line 3"):
        csv_files.read_transactions(spark, str(p)).collect()
    p.write_text(HEAD + "\n" + line(a="x" * 30) + "\n")
    assert csv_files.read_transactions(spark, str(p), "quarantine", max_line_bytes=50).first().error == "line over 50 bytes"


def many_lines(n):
    return [HEAD, *[line(a=f"N{i}", amount=str(i % 977)) for i in range(2, n + 2)]]


def test_row_number_is_the_line_of_a_file_in_many_splits(spark, tmp_path):
    """A file of 3 MB beside small ones, in splits of 64 KB."""
    (tmp_path / "t").mkdir()
    rows = many_lines(50_000)
    (tmp_path / "t/b.csv").write_text("\n".join(rows) + "\n")
    for k in range(5):
        (tmp_path / f"t/a{k}.csv").write_text("\n".join(rows[: 5 + k]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 65536)
    try:
        df = csv_files.read_transactions(spark, str(tmp_path / "t"))
        assert df.rdd.getNumPartitions() > 20
        assert df.filter(F.concat(F.lit("N"), "row_number") != F.col("from_account")).isEmpty() and df.count() == 50_000 + 4 + 5 + 6 + 7 + 8
        assert df.groupBy("file_number").count().count() == 6
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def chunked(folder, text, size, skip=()):
    folder.mkdir(parents=True)
    data = text.encode()
    for k, at in enumerate(range(0, len(data), size)):
        if k not in skip:
            (folder / f"file.csv@{at:012d}").write_bytes(data[at : at + size])
    return len(data)


@pytest.mark.parametrize("size", [7, 64, 1000, 10**6])
def test_lines_that_chunks_break_are_put_together(spark, tmp_path, size):
    text = "\r\n".join(many_lines(12 if size < 64 else 300)) + "\r\n"
    chunked(tmp_path / "t", text, size)
    rows = csv_files.read_transactions(spark, str(tmp_path / "t")).collect()
    assert sorted((r.row_number, r.from_account) for r in rows) == [(i, f"N{i}") for i in range(2, len(text.split("\r\n")))]


def test_upload_in_chunks_refuses_gaps_and_missing_files(spark, tmp_path):
    text, accounts = "\n".join(many_lines(40)), "Bank ID,Bank Name\n001,One\n"
    sizes = {"transactions": len(text), "accounts": len(accounts)}
    chunked(tmp_path / "bad/transactions", text, 100, skip=(3,))
    with pytest.raises(csv_files.BadInput, match="at 400"):
        csv_files.read_transactions(spark, str(tmp_path / "bad/transactions"))
    with pytest.raises(session.IncompleteUpload, match="chunk at 400, expected 300"):
        session.run_upload(spark, "1", str(tmp_path / "bad"), sizes, str(tmp_path / "out"))
    chunked(tmp_path / "up/transactions", text, 100)
    with pytest.raises(session.IncompleteUpload, match="accounts has 0 bytes"):
        session.run_upload(spark, "1", str(tmp_path / "up"), sizes, str(tmp_path / "out"))
    chunked(tmp_path / "up/accounts", accounts, 5)
    paths = session.run_upload(spark, "1", str(tmp_path / "up"), sizes, str(tmp_path / "out"), ("q2", "q5"))
    assert open(paths["q2"]).read() == "From Bank,Account,Bank Name,Amount Paid\n1,N41,One,41.00\n" and open(paths["q5"]).read() == "count\n0\n"


def transfers_of(spark, seed, n=400):
    r = random.Random(seed)
    rows = [(i, f"2022/09/{r.randrange(1, 17):02d} 10:00", f"0{r.randrange(5)}", f"A{r.randrange(9)}", "2", f"B{r.randrange(9)}", r.choice([0.3, 2.0, 900.0, 1000.0]), r.choice(["US Dollar", "US Dollar", "Euro"]), r.choice(["Wire", "ACH", "Cheque"])) for i in range(n)]
    return spark.createDataFrame(rows, ingest.TRANSFER_SCHEMA)


@pytest.mark.parametrize("batches", [1, 5])
def test_partial_results_of_any_split_merge_to_the_batch_queries(spark, tmp_path, batches):
    tx = transfers_of(spark, batches)
    names = spark.createDataFrame([(str(i), f"Bank {i}") for i in range(5)], "bank_id string, bank_name string")
    for b, part in enumerate(tx.randomSplit([1.0] * batches, 3)):
        for _ in range(2 if b == 0 else 1):  # a replayed batch counts once
            partials.write(part, str(tmp_path / "p"), b)
    whole, again = session.results(spark, tx, names, ("q2", "q3", "q5")), session.results(spark, tx, names, ("q2", "q3", "q5"), folder=str(tmp_path / "p"))
    for q in whole:
        assert compare.difference(whole[q], again[q], ("amount_paid",)).count() == 0 and whole[q].count() > 0, q


@pytest.fixture
def scans(spark):
    """The plan as text, with paths and filters in full."""
    spark.conf.set("spark.sql.maxMetadataStringLength", 5000)
    yield lambda df: df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_finished_queries_read_partials_and_candidates_by_row_group(spark, tmp_path, scans):
    src, out = str(tmp_path / "in"), str(tmp_path / "staging")
    transfers_of(spark, 1).write.parquet(src)
    ingest.stage(spark, src, out, str(tmp_path / "ck"), "1")
    folder = ingest.partials_folder(out, "1")
    names = spark.createDataFrame([("1", "One")], "bank_id string, bank_name string")
    found = session.results(spark, ingest.staged(spark, out, "1"), names, folder=folder)
    for q in ("q2", "q5"):
        assert "_partials" in scans(found[q]) and f"{out}/client_id=1" not in scans(found[q])
    plan = scans(found["q3"])
    assert "LessThan(amount," in plan and "PartitionFilters: [isnotnull(fmt" in plan and "Join" not in plan and f"{out}/client_id=1" not in plan
    averages = partials.close_averages(spark, folder).collect()
    partials.write(transfers_of(spark, 9), folder, 7)  # late: the averages stay closed
    assert partials.close_averages(spark, folder).collect() == averages


def test_windows_reach_the_scan_and_candidates_are_not_shuffled(spark, tmp_path, scans):
    path = str(tmp_path / "t")
    transfers_of(spark, 2).write.parquet(path)
    tx = spark.read.parquet(path)
    plan = scans(transfers.far_below_average(tx))
    assert "GreaterThanOrEqual(ts,2022/09/06)" in plan and "LessThanOrEqual(ts,2022/09/15)" in plan and "hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_published_files_and_expectations_round_trip(spark, tmp_path):
    tx = transfers_of(spark, 3).withColumn("from_account", F.concat(F.lit('x "y", '), "from_account")).repartition(4)
    df = transfers.small_usd(tx)
    path = sinks.publish("q1", df, str(tmp_path), "7")
    assert path.endswith("results_q1_7.csv")
    rows = list(csv.reader(open(path)))
    assert rows[0] == sinks.HEADERS["q1"] and len(rows) == df.count() + 1
    expected = sinks.write_expected("q1", df, str(tmp_path), "inline rows")
    assert open(expected).readline() == "# generated by fundtrace from inline rows\n"
    read = lambda p: sinks.read_result(spark, "q1", p)
    assert compare.difference(read(expected), read(path), ("Amount Paid",)).count() == 0 and compare.difference(sinks.as_published("q1", df), read(path), ("Amount Paid",)).count() == 0
    assert sinks.publish("q5", spark.createDataFrame([(3,)], "count long"), str(tmp_path), "7") and not list(tmp_path.glob("*.parts"))


def test_ties_between_batches_go_to_the_earlier_upload(spark, tmp_path):
    src, out, ck = tmp_path / "in", str(tmp_path / "staging"), str(tmp_path / "ck")
    src.mkdir()
    for names in (("a", "b"), ("c",)):
        for n in names:
            (src / f"{n}.csv").write_text(HEAD + "\n" + line(a=f"first-{n}", amount="1") + "\n" + (line(a=n, amount="9") if n != "a" else line()) + "\n")
        ingest.stage(spark, str(src), out, ck, "1", kind="csv")
    assert transfers.largest_per_bank(ingest.staged(spark, out, "1")).first().from_account == "b"
    assert partials.merged({"q2": partials.read(spark, ingest.partials_folder(out, "1"), "q2")})["q2"].first().from_account == "b"
    assert rates.rates(spark).count() == 75
