"""Heuristic quality rules whose cutoffs carry a guarantee, in DataFrame functions only.

Each rule rejects documents above a cutoff of one measure. A cutoff may be used in a stratum (a language) only if the
labelled holdout shows, by an exact binomial test, that it rejects at most FALSE_SHARE / rules of the good documents
there; over all strata, rules and cutoffs the tests together err with a probability of at most ERROR (Bonferroni).
Among such cutoffs the one that tells bad from good best is taken, and none if none does.

Words are [^\\x20\\x09-\\x0D]+. A null text has no words; ties and repeated rows are treated alike; an empty labels
table certifies nothing, and then only the base rules reject.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fundtrace.llm.store import written

GAP = r"[\x20\x09-\x0D]+"
WINDOW = 5
FALSE_SHARE = 0.05
ERROR = 0.05
#: What a share of good documents rejected costs, against the same share of bad ones.
COST = 10.0
#: Measure and cutoffs of each rule.
RULES = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", [0.02, 0.04, 0.06, 0.08, 0.1, 0.15, 0.2, 0.3]),
    "capitals": ("n_capitals / greatest(word_chars, 1)", [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]),
    "lines": ("n_dup_lines / greatest(n_lines, 1)", [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", [0.02, 0.04, 0.06, 0.08, 0.1, 0.12, 0.15, 0.18]),
    "long_words": ("word_chars / greatest(n_words, 1)", [6.0, 7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0]),
}


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_capitals, n_repeat_words, base_failed."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    stratum = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    left = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), stratum.alias("stratum"), words(F.col("text").cast("string")).alias("words"), lines.alias("lines"),
        (F.length(text) - left(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), left("[^A-Z]+").cast("long").alias("n_capitals"))
    counted = base.select(
        "doc_id", "stratum", "n_symbols", "n_capitals", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))).otherwise(F.array().cast("array<long>")).alias("windows"))
    # The distinct windows are counted first: a text without repeats needs no more.
    found = counted.withColumn("pairs", F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"),
        F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:long,i:int>>"))).drop("windows")
    # Equal windows stand side by side; one that equals a neighbour covers five words from its place.
    equal = lambda p, k: F.coalesce(F.get("pairs", k)["h"] == p["h"], F.lit(False))
    flagged = found.withColumn("places", F.sort_array(F.filter(
        F.transform("pairs", lambda p, k: F.when(equal(p, k - 1) | equal(p, k + 1), p["i"])), lambda i: i.isNotNull()))).drop("pairs")
    state = F.struct(F.lit(0).alias("n"), F.lit(0).alias("until"))
    covered = F.aggregate("places", state, lambda s, p: F.struct((s["n"] + p + WINDOW - F.greatest(p, s["until"])).alias("n"), (p + WINDOW).alias("until")), lambda s: s["n"])
    out = flagged.withColumn("n_repeat_words", covered.cast("long")).drop("places")
    return out.withColumn("base_failed", F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words"))


def _binomial_tail(k: Column, n: Column, p: float) -> Column:
    """log P(Binomial(n, p) <= k), summed term by term."""
    import math

    start = F.struct((n * math.log1p(-p)).alias("term"), (n * math.log1p(-p)).alias("sum"))

    def add(s, j):
        term = s["term"] + F.log(n - j + 1) - F.log(j.cast("double")) + math.log(p) - math.log1p(-p)
        return F.struct(term.alias("term"), (F.greatest(s["sum"], term) + F.log1p(F.exp(-F.abs(s["sum"] - term)))).alias("sum"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>"))
    return F.aggregate(steps, start, add, lambda s: s["sum"])


def certified(holdout: DataFrame, false_share: float = FALSE_SHARE, error: float = ERROR) -> DataFrame:
    """stratum, rule, cutoff from (stratum, measures, good 0/1) rows."""
    import math

    sums = [F.sum(F.col("good").cast("long")).alias("n_good"), F.sum(1 - F.col("good").cast("long")).alias("n_bad")]
    cells = []
    for rule, (measure, cutoffs) in RULES.items():
        for i, c in enumerate(cutoffs):
            above = F.expr(measure) > c
            for kind, want in (("good", 1), ("bad", 0)):
                sums.append(F.count_if(above & (F.col("good") == want)).alias(f"{rule}_{i}_{kind}"))
            cells.append(F.struct(F.lit(rule).alias("rule"), F.lit(float(c)).alias("cutoff"), F.col(f"{rule}_{i}_good").alias("k"), F.col(f"{rule}_{i}_bad").alias("hits")))
    counts = holdout.groupBy("stratum").agg(*sums)
    strata = counts.agg(F.count("*").alias("strata"))
    tested = counts.crossJoin(F.broadcast(strata)).select("stratum", "n_good", "n_bad", "strata", F.explode(F.array(*cells)).alias("c")).select("stratum", "n_good", "n_bad", "strata", "c.*")
    share = false_share / len(RULES)
    tests = sum(len(c) for _, c in RULES.values())
    # A test can only succeed below the share itself.
    passed = (
        tested.filter(F.col("k") <= share * F.col("n_good"))
        .filter(_binomial_tail(F.col("k"), F.col("n_good").cast("double"), share) <= math.log(error / tests) - F.log(F.col("strata").cast("double")))
        .withColumn("worth", F.col("hits") / F.greatest("n_bad", F.lit(1)) - COST * F.col("k") / F.greatest("n_good", F.lit(1))).filter("worth > 0")
    )
    return passed.groupBy("stratum", "rule").agg(F.max(F.struct("worth", "cutoff"))["cutoff"].alias("cutoff"))


def quality_rules(docs: DataFrame, labels: DataFrame, false_share: float = FALSE_SHARE, error: float = ERROR) -> DataFrame:
    """The measures of each document, base_failed, failed_rules (the method's, by name) and kept."""
    m = written(measured(docs), "measures")
    good = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("good"))
    rules = certified(m.join(good, "doc_id"), false_share, error)
    # One row per stratum that has certified rules; each needs hundreds of labels, so there are few.
    table = rules.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES]).collect()
    cut = {r: F.lit(None).cast("double") for r in RULES}
    if table:
        for r in RULES:
            pairs = [(x["stratum"], x[f"cut_{r}"]) for x in table if x[f"cut_{r}"] is not None]
            if pairs:
                cut[r] = F.try_element_at(F.create_map(*[F.lit(v) for p in pairs for v in p]), F.col("stratum"))
    failed = F.array_compact(F.array(*[F.when(F.expr(measure) > cut[r], F.lit(r)) for r, (measure, _) in RULES.items()]))
    return m.withColumn("failed_rules", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


CONTRACT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*CONTRACT)


def _sql() -> str:
    tests = sum(len(c) for _, c in RULES.values())
    share = FALSE_SHARE / len(RULES)
    grid = ", ".join(f"('{r}', {c}::DOUBLE)" for r, (_, cs) in RULES.items() for c in cs)
    measure = "CASE rule " + " ".join(f"WHEN '{r}' THEN {m}" for r, (m, _) in RULES.items()) + " END"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY doc_id),
m0 AS (SELECT d.doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS BIGINT) AS n_capitals, len(lines) AS n_lines,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
      FROM d JOIN l USING (doc_id) LEFT JOIN cov USING (doc_id)),
m AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m0),
g AS (SELECT m.*, good FROM m JOIN (SELECT doc_id, min(quality) AS good FROM labels GROUP BY doc_id) USING (doc_id)),
t AS (SELECT stratum, rule, cutoff, sum(good) AS n_good, sum(1 - good) AS n_bad, count(*) FILTER (good = 1 AND {measure} > cutoff) AS k,
             count(*) FILTER (good = 0 AND {measure} > cutoff) AS hits FROM g, (VALUES {grid}) r(rule, cutoff) GROUP BY ALL),
s AS (SELECT count(DISTINCT stratum) AS strata FROM t),
ok AS (SELECT stratum, rule, arg_max(cutoff, (worth, cutoff)) AS cutoff FROM (
         SELECT *, hits / greatest(n_bad, 1) - {COST} * k / greatest(n_good, 1) AS worth,
                list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n_good + 1) - lgamma(j + 1) - lgamma(n_good - j + 1) + j * ln({share}) + (n_good - j) * ln(1 - {share})))) AS tail
         FROM t WHERE k <= {share} * n_good) CROSS JOIN s WHERE tail <= {ERROR} / {tests} / strata AND worth > 0 GROUP BY stratum, rule),
bad AS (SELECT DISTINCT doc_id FROM m JOIN ok USING (stratum) WHERE {measure} > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM m
"""


SQL = _sql()
