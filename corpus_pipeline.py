"""A corpus pipeline: documents in, packed training sequences out, one operator a stage.

Each stage takes (spark, docs, sf_dir), docs being what the stage before has written, and returns a DataFrame. All but
the last return the columns of documents. Every stage takes nulls in any column, empty and very long texts, ties and repeated rows, and
columns of any name; an empty table gives none. What becomes of them is said with each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setweave.llm.frames import free, named, written
from setweave.llm.mixing import take_copies
from setweave.llm.packing import pack_documents
from setweave.llm.pii import mask
from setweave.llm.quality import quality_rules, with_score
from setweave.llm.simhash import drop_near_duplicates
from setweave.llm.tokens import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules, learned from the labels outside the held-out fold, score 0.3 or more.

    A null text counts as empty and is scored; a row without id or label is scored like any other; equal texts go or stay
    together. Without any label the score is a half, so all stay."""
    rules = quality_rules(spark, docs, sf_dir)
    score = free(docs.columns, "score")
    return with_score(docs, rules, name=score).where(F.col(score) >= 0.3).select(*named(docs.columns))


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates: five-word shingles with a Jaccard similarity of 0.8 or more.

    Rows are told apart by their place, so one id may stand for several texts; the smallest id of a group stays, a null
    one last. Null, empty and blank texts are one group."""
    return drop_near_duplicates(docs, words=5, similarity=(4, 5))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars follows the text.

    No row goes. A null text stays null, and so does its n_chars."""
    return mask(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them.

    A null source is one of its own; a text without words, null ones as well, is not taken; repeated rows are drawn each for
    itself, and the same rows give the same copies."""
    return take_copies(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of 4096 tokens.

    A null or empty text is its end id alone; copies of a document are packed each for itself, a null id stays null."""
    return pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality", quality), ("simhash", simhash), ("pii", pii), ("mixing", mixing), ("packing", packing)]

#: The random draws of mixing, the fit of the rules and the placing of pieces have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's are written to the cluster's shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
