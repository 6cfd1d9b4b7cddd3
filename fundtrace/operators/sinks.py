"""CSV results with the published headers."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Published headers by query, in the order of the result's columns.
HEADERS = {
    "q1": ["From Bank", "Account", "To Bank", "Account.1", "Amount Paid"],
    "q2": ["From Bank", "Account", "Bank Name", "Amount Paid"],
    "q3": ["From Bank", "Account", "Payment Format", "Amount Paid"],
    "q4": ["Bank", "Account"],
    "q5": ["count"],
}


def two_decimals(amount: Column) -> Column:
    """Two decimals, rounded by the number's binary value, halves to even, for amounts below 10 ** 13; format_string and round take its shortest decimal form."""
    return F.when(~F.isnan(amount), F.translate(F.format_number(amount, 2), ",", ""))


def as_published(query: str, df: DataFrame, formatter=None) -> DataFrame:
    cols = [(formatter or two_decimals)(F.col(c)) if c == "amount_paid" else F.col(c) for c in df.columns]
    return df.select(*[c.alias(h) for c, h in zip(cols, HEADERS[query])])


def write_result(query: str, df: DataFrame, out_dir: str, client: str) -> str:
    """Overwrites the client's folder for this query, so writing again changes nothing."""
    path = f"{out_dir}/results_{query}/client_id={client}"
    as_published(query, df).write.mode("overwrite").option("header", True).csv(path)
    return path


def _in_one_file(df: DataFrame, path: str, lines: list[str]) -> str:
    """df as one CSV file below these lines. Tasks write its parts side by side; the file system joins them in order where it can (concat), else
    their bytes are copied one after the other. The file appears whole, in one rename."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path
    parts, target = at(f"{path}.parts"), at(path)
    df.write.mode("overwrite").option("header", False).option("escape", '"').csv(parts.toString())
    fs = target.getFileSystem(conf)
    whole = at(f"{path}.whole")
    out = fs.create(whole, True)
    out.write(bytearray("".join(x + "\n" for x in lines).encode()))
    out.close()
    names = sorted(s.getPath().getName() for s in fs.listStatus(parts) if s.getPath().getName().startswith("part-") and s.getLen())
    every = [at(parts, n) for n in names]
    if every:
        sources = spark.sparkContext._gateway.new_array(at, len(every))
        for i, p in enumerate(every):
            sources[i] = p
        try:
            fs.concat(whole, sources)
        except Exception as error:  # the file system's own error, through the gateway
            if "UnsupportedOperation" not in type(error).__name__ + str(error):
                raise
            joined = at(f"{path}.joined")
            out = fs.create(joined, True)
            for p in (whole, *every):
                source = fs.open(p)
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
                source.close()
            out.close()
            fs.delete(whole, False)
            whole = joined
    fs.delete(target, False)
    if not fs.rename(whole, target):
        raise OSError(f"{whole} can't become {target}")
    fs.delete(parts, True)
    return path


def publish(query: str, df: DataFrame, out_dir: str, client: str) -> str:
    """The client's result under its published name."""
    return _in_one_file(as_published(query, df), f"{out_dir}/results_{query}_{client}.csv", [",".join(HEADERS[query])])


def write_expected(query: str, df: DataFrame, folder: str, source: str) -> str:
    """A result as the expectation of later runs, with a first line that says what it was made from."""
    return _in_one_file(as_published(query, df), f"{folder}/expected_results/{query}.csv", [f"# generated by fundtrace from {source}", ",".join(HEADERS[query])])


def read_result(spark, query: str, path: str) -> DataFrame:
    """A result or expectation, a file or a folder of parts, as text in the published columns; lines that begin with # say what it was made from."""
    schema = ", ".join(f"`{h}` string" for h in HEADERS[query])
    return spark.read.option("header", True).option("enforceSchema", True).option("comment", "#").option("escape", '"').schema(schema).csv(path)
