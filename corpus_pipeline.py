"""A corpus made ready for training: five stages, each written and read again before the next.

Stages judge rows, not doc_ids: rows without a doc_id are treated like all others, and of rows that share a doc_id but not
a text each has its own verdict. Equal rows (doc_id and text) have the same one. Null and empty texts have no language and
go in the first stage; of ties in a group the smallest doc_id stays, then the smallest key. Columns besides those of
documents are kept as they are, whatever their names; an empty table gives an empty result.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundtrace.llm import decontaminate, jaccard, language, packing, substring
from fundtrace.llm.store import checked_broadcast, written


ROW, KEPT = "__row_key", "__kept"


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a key that only rows of equal doc_id and text share, nulls included."""
    return docs.withColumn(ROW, F.xxhash64("doc_id", "text", F.isnull("doc_id"), F.isnull("text")))


def _by_row(docs: DataFrame) -> DataFrame:
    """What operators take, with the row's key for its doc_id."""
    return _keyed(docs).select(F.col(ROW).alias("doc_id"), "text")


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of docs (with their keys) whose key isn't among rows; the keys are broadcast only while they are few, else both are shuffled."""
    return docs.join(checked_broadcast(rows.select(ROW).distinct()), ROW, "left_anti")


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without any letter, which have no language, go."""
    return language.accepted(docs)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near-equal shingles, directly or through others, the one with the smallest doc_id stays.

    Rows without a doc_id come after all others; of equal doc_ids and of none, the smallest key stays.
    """
    found = jaccard.join(_by_row(docs)).filter("n_shingles > 0")
    groups = written(found.groupBy(F.col("doc_id").alias(ROW), "component_id").agg(F.count("*").alias("n")), "groups")
    names = _keyed(docs).select(ROW, "doc_id").distinct()
    first = F.min(F.struct(F.isnull("doc_id").alias("nameless"), "doc_id", ROW)).alias("first")
    stay = groups.join(names, ROW).groupBy("component_id").agg(first).select(F.col(f"first.{ROW}").alias(ROW))
    gone = written(groups.select(ROW).join(stay, ROW, "left_anti"), "gone")
    kept = _without(_keyed(docs), gone)
    again = written(groups.filter("n > 1").select(ROW).join(gone, ROW, "left_anti"), "again")
    if again.isEmpty():
        return kept.select(*docs.columns)
    # Equal rows are in one group: one of them stays.
    one = kept.join(checked_broadcast(again), ROW, "left_semi").dropDuplicates([ROW])
    return _without(kept, again).unionByName(one).select(*docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that stand elsewhere too go; other documents keep their text as it is."""
    found = substring.dedup(_by_row(docs)).filter("n_removed > 0").select(F.col("doc_id").alias(ROW), F.col("kept").alias(KEPT))
    changed = written(found.dropDuplicates([ROW]), "changed")
    rest = _keyed(docs).drop("text", "n_chars").join(changed, ROW)
    new = rest.withColumn("text", F.col(KEPT)).withColumn("n_chars", F.length(KEPT).cast("long"))
    return _without(_keyed(docs), changed).select(*docs.columns).unionByName(new.select(*docs.columns))


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages make a twentieth or more go."""
    found = decontaminate.decontaminate(_by_row(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = written(found.filter("contaminated").select(F.col("doc_id").alias(ROW)), "contaminated")
    return _without(_keyed(docs), gone).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(docs, packing.tokenizer_path())).select(*packing.CONTRACT)


STAGES = [
    ("language", keep_known_languages),
    ("near_duplicates", keep_one_of_each_group),
    ("substring_dedup", cut_repeated_passages),
    ("decontamination", keep_uncontaminated),
    ("packing", packed),
]

#: SQL can express neither the language machines nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
