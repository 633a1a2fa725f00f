"""A training corpus from documents: quality classifier, line dedup, n-gram Jaccard join, mixing, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents.  Stages are written as Parquet and read again, so a lost executor costs at most one stage.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.llm import jaccard, linededup, mixing, packing, quality
from cuemill.llm.common import discard, store, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, trained on these documents' labels, does not reject."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs.select(*COLUMNS), model).filter(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that other documents repeat; n_chars follows the text."""
    out = linededup.drop_repeated_lines(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: one with the smallest doc_id, null the smallest.  Texts without words have no group."""
    return jaccard.one_of_each(docs.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: rows repeat documents, or parts of them, as often as the mix takes them."""
    return mixing.mixed_texts(docs).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mixed documents, their token ids (32-bit little-endian) and their places in sequences: the ids of a
    sequence_id by offset are a training sequence."""
    return packing.packed_documents(docs, known_chunks=300_000)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("mixing sources to target weights", mix),
    ("best-fit packing", pack),
]

#: Boosted trees, pseudorandom permutations and a tokenizer are beyond SQL; tests/llm checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        last, docs = docs, store(stage(spark, docs, sf_dir), "stage-" + name.lower().replace(" ", "-"))
        discard(last)
    return STAGES[-1][1](spark, docs, sf_dir)
