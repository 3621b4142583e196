"""Corpus curation in five stages over documents; each reads what the one before has written.

Stages return the columns of documents (the last: ids and digests of the encoded texts). A row is kept unless a
stage's own finding is against it:

toxicity                     rows with a score of REJECT or more go
MinHash near-dedup           of each group of near copies the row with the smallest doc_id stays; repeated rows once
suffix-array dedup           repeated strings of 200 bytes are cut out, each copy of them; rows that had text and have none left go
benchmark decontamination    rows that share ten words in a row with a benchmark item go
BPE                          texts are encoded and decoded

Null and empty texts pass all stages; null ids are allowed; an empty table stays empty; extra columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import bpe, minhash, repeats, toxicity, winnowing
from sparkloom.session import written


NAMED = ("doc_id", "text", "n_chars")


def _apart(stage):
    """The stage over documents whose other columns have names that no operator uses; they get their own back."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        found = stage(spark, docs.toDF(*[c if c in NAMED else f"own {i}" for i, c in enumerate(docs.columns)]), sf_dir)
        return found.toDF(*docs.columns)

    return run


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


@_apart
def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    net = toxicity.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.with_scores(docs, net).where(F.col("score") < toxicity.REJECT).select(*_columns(docs))


@_apart
def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = minhash.near_groups(docs)
    # the row of each group that stays: smallest id, then smallest text hash; texts without words stay alone
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("k"), "doc_id", "text_hash")).alias("lead")
    leads = groups.where("n_shingles > 0").groupBy("g1", "g2").agg(lead).select(F.col("lead.doc_id").alias("__id"), F.col("lead.text_hash").alias("__hash"))
    empty = groups.where("n_shingles = 0").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    stay = leads.unionByName(empty).distinct()
    text_hash = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    kept = docs.join(stay, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (text_hash == F.col("__hash")))
    order = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return kept.groupBy("__id", "__hash").agg(F.min_by(F.struct(*_columns(docs)), F.to_json(F.struct(*order)) if order else F.lit(0)).alias("r")).select("r.*")


@_apart
def repeats_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = repeats.cut(docs)
    left = cut.where(~F.col("__cut") | (F.length("__kept") > 0))
    new = {"text": F.when(F.col("__cut"), F.col("__kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("__cut"), F.length("__kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return left.withColumns(new).select(*_columns(docs))


@_apart
def benchmarks_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = winnowing.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(~F.col("contaminated")).select(*_columns(docs))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_and_decode(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), keep=["doc_id"])


STAGES = [
    ("toxicity", toxic_out),
    ("minhash_near_dedup", near_copies_out),
    ("suffix_array_dedup", repeats_out),
    ("benchmark_decontamination", benchmarks_out),
    ("bpe", encoded),
]

#: Stages train and apply a network and work on bytes; SQL can't express them, so run() is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
