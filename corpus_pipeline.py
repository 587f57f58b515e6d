"""A corpus pipeline of five stages; each takes and returns documents.

quality classifier -> MinHash near-dedup -> suffix-array dedup -> benchmark
decontamination -> mixing to target weights. `run` applies them to
`documents`; every stage sees all that the one before kept. No stage can be
put in SQL as a whole, so ORACLE_SQL is None and tests compare with brute force.

Defined results, for every stage: any column may be null; an empty table gives
an empty table; rows may repeat; columns that `documents` doesn't have are
dropped, whatever their names, by all stages but the last, which carries them.
What a stage does with ties, nulls and repeated rows is said at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textplan.llm import decontaminate, mixing, near_dup, quality, repeats
from textplan.llm._store import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in COLUMNS])


def _with_text(df: DataFrame, text) -> DataFrame:
    return _documents(df.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    A score depends on the text alone, so rows that repeat share their fate;
    null and empty texts score as an empty text does; ids may be null. A score
    that ties with the cut is kept. Without any label nothing can be learned
    and every document stays.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _documents(quality.classify(docs, labels).where("predicted = 1"))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that with the smallest id, and one row of it if rows repeat it.

    Five-word shingles, similarity 0.8. Documents without an id or without
    words are in no group and stay.
    """
    found = near_dup.near_duplicates(docs.select("doc_id", "text"), size=5, percent=80)
    gone = found.where("n_shingles > 0 and doc_id is not null and not kept").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti")
    # Of rows that share an id, the least text: ids repeat seldom, so only those rows meet in an aggregation.
    again = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return _documents(left)
    others = [c for c in COLUMNS if c != "doc_id"]
    one = left.join(again, "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.coalesce("text", F.lit("")).alias("_"), *others)).alias("r")).select("doc_id", "r.*")
    return _documents(left.join(again, "doc_id", "left_anti")).unionByName(_documents(one))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that occur elsewhere are cut out; characters cut in half go whole.

    All copies of a passage are cut, so rows that repeat as a whole lose it in
    each; null texts become empty ones.
    """
    found = repeats.suffix_array_dedup(docs, width=200, as_text=True)
    return _with_text(found, F.col("kept"))


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of benchmark windows are cut out of documents; null texts stay null, an empty benchmark cuts nothing."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.find_benchmark(docs, benchmark)
    return _with_text(found, F.expr(decontaminate.without_spans()))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes; in place of the text, its size, its source's size and target, and the words taken.

    A null text has no words and a null source is one of its own, weighed
    last; rows that repeat are taken each for itself.
    """
    return mixing.mix_sources(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", keep_one_of_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", cut_benchmark),
    ("mixing to target weights", mix_to_weights),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.keep(f"stage-{i}", docs)
    return docs
