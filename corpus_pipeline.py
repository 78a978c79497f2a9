"""From raw documents to packed sequences: STAGES in order, each reading what the one before it wrote.

Every stage works on all its predecessor kept: toxicity (texts with a score of 0.5 or more go), MinHash near-dedup (of
each group the smallest id stays), substring dedup (passages of 50 words or more stay in the earliest document only),
mixing (documents are taken 0 to 2 times towards the weights of their sources) and best-fit packing (a row per piece
with its sequence). All but the last return the columns of documents.

Null and empty texts are no one's duplicates, aren't toxic, have size 0 in the mix and pack
as the closing id alone. Ties go to the smallest doc_id; rows with equal id and text count as one from the second stage
on. Empty tables give empty tables. Very long texts are worked on whole. Other columns may have any name and are kept.
A stage deletes the intermediate tables of the stage called before it, whose result must be written by then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import minhash, mixing, packing, substrings, toxicity
from tallyloom.llm.common import apart, collecting, discard, fresh

_temporary: list[str] = []


def _stage(work):
    """Before a stage begins, its predecessor's result has been written, so the predecessor's own tables can go."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard(spark, _temporary)
        with collecting(_temporary):
            return work(spark, docs, sf_dir)

    return run_stage


@_stage
def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    packed, back = apart(docs, "doc_id", "text")
    scored = toxicity.scored(packed, spark.read.parquet(f"{sf_dir}/labels.parquet"), "_toxicity")
    return scored.filter("_toxicity < 0.5").select(*back)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.one_of_each(docs)


@_stage
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(docs)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces_of(docs))


STAGES = [
    ("toxicity", toxic),
    ("minhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: The stages learn, hash and tokenize; SQL cannot express them. tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        path = fresh(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        discard(spark, before)
        before = [path]
    packed = STAGES[-1][1](spark, docs, sf_dir)
    _temporary.clear()  # what the lazy result reads stays, whatever runs after this
    return packed
