"""A corpus pipeline over documents: five stages, each one of the corpus operators at work.

Toxic documents go, one document of each near-duplicate group stays, secrets are
replaced in the texts, sources are mixed to their target weights (a document stays
once for each copy that the mix takes), and the texts are encoded.  Each stage
reads all that the one before it kept; ``run`` writes each stage's rows to the
shared folder and reads them again, and deletes what a stage wrote on its way.

Every stage takes an empty table and gives one, keeps columns that it does not know
whatever their names, and judges repeated rows alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import minhash, mixing, pieces, secrets, toxicity
from tracelake.llm.textkit import clear, drop, mark, padding, settle


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the factorization machine does not reject; all labels may be learnt from.

    Null and empty texts score alike, by the machine's constant alone; equal texts stay or
    go together.  Without labels of both classes nothing is known, and a document goes only
    if all labels say toxic.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.train(docs, labels, F.lit(True)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that HyperMinHash links: five-word shingles, similarity 0.8 or more.

    The smallest doc_id stays.  Rows that share a doc_id are one document, of which
    all rows stay or go; rows with a null doc_id, and null, empty and blank texts, stay.
    """
    found = minhash.near_duplicates(docs, k=5, threshold=0.8)
    # a plain table, so that a hot id can be split; null ids meet nothing, so they are spread
    gone = settle(found.where("not kept").select("doc_id", F.lit(0).cast("long").alias("_pad")).distinct(), "pipeline-gone")
    return docs.withColumn("_pad", padding(spark, "doc_id")).join(gone, ["doc_id", "_pad"], "left_anti").select(docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with every secret found in their texts replaced by a mark; n_chars follows.

    Null and empty texts stay as they are, and no row goes.
    """
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix to target weights takes it; those it takes no copy of go.

    A null source is a source of its own.  Null and empty texts have no words, so the mix
    takes each as often as its source's whole rate says, without the fraction.  Equal rows
    share their copies.
    """
    return mixing.draw(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the ids of their texts' pieces, and whether the two libraries agree on them.

    A null text has null ids and parity, an empty one no ids.  Columns named ids or parity
    give way.
    """
    return pieces.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("pieces", encode),
]

#: Classifier scores, entropy spans, random rounding and a tokenizer are beyond SQL;
#: the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        began, given = mark(), docs
        docs = settle(stage(spark, given, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        clear(spark, began, keep=docs)  # what the stage wrote and broadcast on its way
        drop(given)
    return docs
