"""CSV sources: columns are found by header name, wherever they stand; a row knows the line of its file.

A file is one CSV file, or its chunks: files `name@offset` that hold its bytes from there on. Lines are numbered in two passes. The first counts the
lines of each split; sums over the splits before give each split its first number. A line that chunks break is put together again, and a gap between
chunks is refused. Lines end at \\n; a \\r before it goes.
"""

import csv

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fundtrace.functions.expressions import ascii_digits, bank_id, stripped
from fundtrace.operators.transfers import closed

#: Widest UTF-8 value in bytes that each text column may hold.
MAX_BYTES = {"ts": 19, "from_bank": 16, "from_account": 32, "to_bank": 16, "to_account": 32, "currency": 32, "fmt": 32}
MAX_LINE_BYTES = 16 << 20
TRANSACTION_FIELDS = ["ts", "from_bank", "from_account", "to_bank", "to_account", "amount", "currency", "fmt"]


class BadInput(ValueError):
    """The header, the chunks of a file, or a row in fail-fast mode, can't be read."""


def transaction_positions(header: list[str]) -> dict[str, int]:
    """Place of each field; an account is the first column called Account behind its bank's column."""
    names = [h.strip().lstrip("﻿") for h in header]

    def place(name: str, after: int = -1) -> int:
        try:
            return names.index(name, after + 1)
        except ValueError:
            raise BadInput(f"no column {name!r} in header {names}") from None

    sender, receiver = place("From Bank"), place("To Bank")
    return {
        "ts": place("Timestamp"), "from_bank": sender, "from_account": place("Account", sender), "to_bank": receiver,
        "to_account": place("Account", receiver), "amount": place("Amount Paid"), "currency": place("Payment Currency"),
        "fmt": place("Payment Format"),
    }


def account_positions(header: list[str]) -> tuple[int, int]:
    names = [h.strip().lstrip("﻿") for h in header]
    if "Bank ID" not in names or "Bank Name" not in names:
        raise BadInput(f"no bank columns in header {names}")
    return names.index("Bank ID"), names.index("Bank Name")


def text_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """What `numbered` takes: the lines of files, with the file's metadata."""
    return spark.read.option("lineSep", "\n").text(paths).select("value", "_metadata")


def numbered(text: DataFrame) -> tuple[DataFrame, dict[str, list[str]]]:
    """(file, number, line) of each line, from 1, the header included; and the header's fields of each file.

    text: value and _metadata. Raises BadInput for chunks that don't follow each other.
    """
    lines = text.select(
        F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.col("_metadata.file_size").alias("size"), "value",
        F.expr("monotonically_increasing_id() & ((1L << 33) - 1)").alias("pos"))
    counts = lines.groupBy("f", "b").agg(
        F.count("*").alias("n"), F.min("pos").alias("first"), F.sum(F.octet_length("value") + 1).alias("bytes"), F.min_by("value", "pos").alias("head"), F.max("size").alias("size"))
    name, chunk, order = F.regexp_replace("f", r"@\d+$", ""), Window.partitionBy("f"), Window.partitionBy("file").orderBy("offset", "b")
    # A chunk whose last line has no end is one byte longer with an end behind each line. One row for each split: a file's are put in order by one task.
    placed = (
        counts.withColumn("file", name).withColumn("offset", F.coalesce(F.expr(r"try_cast(regexp_extract(f, '@(\\d+)$', 1) AS BIGINT)"), F.lit(0)))
        .withColumn("broken", F.sum("bytes").over(chunk) > F.col("size")).withColumn("starts", F.col("b") == F.min("b").over(chunk)).withColumn("ends", F.col("b") == F.max("b").over(chunk))
        .withColumn("goes_on", F.col("starts") & F.coalesce(F.lag("broken").over(order), F.lit(False)))
        .withColumn("gap", F.col("starts") & (F.coalesce(F.lag(F.col("offset") + F.col("size")).over(order), F.lit(0)) != F.col("offset")))
        .withColumn("last_chunk", F.col("offset") == F.max("offset").over(Window.partitionBy("file")))
        .withColumn("start", 1 + F.sum("n").over(order) - F.col("n") - F.sum(F.col("goes_on").cast("long")).over(order))
    )
    splits = closed(placed.select("f", "b", "file", "offset", "n", "first", "start", "goes_on", (F.col("broken") & F.col("ends") & ~F.col("last_chunk")).alias("broken"), "gap", "starts", "head"))
    if gaps := splits.filter("gap").select("file", "offset").limit(3).collect():
        raise BadInput("bytes before these are missing, or there twice: " + ", ".join(f"{g.file} at {g.offset}" for g in gaps))
    heads = splits.filter("start = 1 AND starts").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("offset", "head"))).alias("h")).collect()
    headers = {r.file: next(csv.reader(["".join(x.head for x in r.h).rstrip("\r")]), []) for r in heads}

    unknown = F.raise_error(F.lit("the files, or how they are split, changed between two passes")).cast("long")
    at = lines.join(splits.drop("head", "gap", "starts"), ["f", "b"], "left").withColumn("number", F.coalesce(F.col("start") + F.col("pos") - F.col("first"), unknown))
    whole = F.regexp_replace("value", "\r$", "").alias("line")
    if splits.filter("goes_on").isEmpty():
        return at.select("file", "number", whole), headers
    part = (F.col("goes_on") & (F.col("pos") == F.col("first"))) | (F.col("broken") & (F.col("pos") == F.col("first") + F.col("n") - 1))
    # Two parts for each break, or more of a line longer than a chunk, which is held to the largest line size.
    joined = at.filter(part).groupBy("file", "number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "value"))), lambda x: x["value"]), "").alias("value"))
    return at.filter(~part).select("file", "number", whole).unionByName(joined.select("file", "number", whole)), headers


# A field as Python's csv module reads one line: quoted, with what follows its closing quote up to the comma, or as it stands.
_QUOTED = r'"((?:[^"]++|"")*+)(?:"([^,]*+)|$)'
_FIELD = r'"(?:[^"]++|"")*+(?:"[^,]*+|$)|[^,]*+'


def fields(line: Column) -> Column:
    """Raw fields of a CSV line; `unquoted` gives their values."""
    return F.when(~F.contains(line, F.lit('"')), F.split(line, ",", -1)).otherwise(F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(f"(?s),({_FIELD})"), 1))


def unquoted(field: Column) -> Column:
    inner = F.replace(F.regexp_extract(field, f"(?s)^{_QUOTED}", 1), F.lit('""'), F.lit('"'))
    return F.when(F.startswith(field, F.lit('"')), F.concat(inner, F.regexp_extract(field, f"(?s)^{_QUOTED}", 2))).otherwise(field)


def number_of(text: Column) -> Column:
    """A decimal number as the text has it, else null: neither type suffixes nor names of values."""
    plain = F.when(text.rlike(r"^[\x00-\x7F]*$"), text).otherwise(ascii_digits(text))
    form = r"^[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"
    return F.when(plain.rlike(form), F.replace(plain, F.lit("_"), F.lit("")).try_cast("double"))


def parsed(lines: DataFrame, headers: dict[str, list[str]], mode: str = "failfast", first_file: int = 0, max_line_bytes: int = MAX_LINE_BYTES) -> DataFrame:
    """Transfers of numbered lines; see read_transactions. file_number counts the files by name from first_file on."""
    files = sorted(headers)
    spark = lines.sparkSession
    ranks = spark.createDataFrame([(f, first_file + k, sorted({tuple(h) for h in headers.values()}).index(tuple(headers[f]))) for k, f in enumerate(files)], "file string, file_number long, kind int")
    known = lines.filter("number > 1").join(F.broadcast(ranks), "file")
    whole = None
    for kind, header in enumerate(sorted({tuple(h) for h in headers.values()})):
        part = _parsed(known.filter(F.col("kind") == kind), list(header), mode, max_line_bytes)
        whole = part if whole is None else whole.unionByName(part)
    return whole


def read_transactions(spark: SparkSession, path: str | list[str], mode: str = "failfast", max_line_bytes: int = MAX_LINE_BYTES) -> DataFrame:
    """Transfers of one CSV file, a folder or a list of files or chunks, each file by its own header.

    mode: failfast raises for the first bad row as the query runs, naming its file and line; quarantine returns all rows with columns
    `error`, null for good ones, and `line`. A row is bad if its field count differs from the header's, a needed field is
    empty or too wide, its line is empty, too long or no UTF-8, or the amount isn't a finite number. row_number is the line within the file, the header being
    line 1; file_number orders files by name.
    """
    lines, headers = numbered(text_lines(spark, path))
    if not headers:
        raise BadInput(f"{path} has no header")
    return parsed(lines, headers, mode, 0, max_line_bytes)


def _parsed(lines: DataFrame, header: list[str], mode: str, max_line_bytes: int) -> DataFrame:
    at = transaction_positions(header)
    split = lines.withColumn("r", fields(F.col("line")))
    value = {name: stripped(unquoted(F.try_element_at("r", F.lit(i + 1)))) for name, i in at.items()}
    split = split.select("*", *[v.alias(k) for k, v in value.items()])
    amount = number_of(F.col("amount"))
    empty = F.coalesce(*[F.when(F.coalesce(F.col(k), F.lit("")) == "", F.lit(f"empty {k}")) for k in value])
    wide = F.coalesce(*[F.when(F.octet_length(k) > w, F.lit(f"{k} over {w} bytes")) for k, w in MAX_BYTES.items()])
    error = F.coalesce(
        F.when(F.octet_length("line") > max_line_bytes, F.lit(f"line over {max_line_bytes} bytes")), F.when(F.col("line") == "", F.lit("empty line")), F.when(~F.is_valid_utf8("line"), F.lit("no UTF-8")),
        F.when(F.size("r") != len(header), F.concat(F.lit("fields: "), F.size("r").cast("string"))), empty, wide,
        F.when(amount.isNull() | (F.abs(amount) == float("inf")), F.lit("amount isn't a finite number")),
    )
    out = split.select(F.col("number").alias("row_number"), "file_number", "file", *[(amount if k == "amount" else F.col(k)).alias(k) for k in TRANSACTION_FIELDS], error.alias("error"), "line")
    if mode == "quarantine":
        return out
    if mode != "failfast":
        raise ValueError(f"mode {mode!r}")
    told = F.concat(F.lit("bad row: "), "error", F.lit(" in "), "file", F.lit(" line "), F.col("row_number").cast("string"), F.lit(": "), F.substring("line", 1, 200))
    ok = F.when(F.col("error").isNotNull(), F.raise_error(told).cast("double"))
    return out.withColumn("amount", F.coalesce(ok, "amount")).select("row_number", "file_number", *TRANSACTION_FIELDS)


def parsed_accounts(lines: DataFrame, headers: dict[str, list[str]]) -> DataFrame:
    """Distinct (bank_id, bank_name) of numbered lines; short lines and empty bank ids are left out, an empty name is one."""
    spark = lines.sparkSession
    places = spark.createDataFrame([(f, *account_positions(h)) for f, h in headers.items()], "file string, id_at int, name_at int")
    split = lines.filter("number > 1 AND line != ''").join(F.broadcast(places), "file").withColumn("r", fields(F.col("line"))).filter("size(r) > greatest(id_at, name_at)")
    field = lambda c: unquoted(F.element_at("r", F.col(c) + 1))
    return split.select(bank_id(field("id_at")).alias("bank_id"), stripped(field("name_at")).alias("bank_name")).filter("bank_id != ''").distinct()


def read_accounts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    lines, headers = numbered(text_lines(spark, path))
    if not headers:
        raise BadInput(f"{path} has no header")
    return parsed_accounts(lines, headers)
