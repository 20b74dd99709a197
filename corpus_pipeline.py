"""A corpus pipeline: toxic documents, near duplicates and benchmark passages go; sources are mixed; ids are stored.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns the next stage's docs, with the
columns of documents; the last returns a row for each document of the store.

Every stage takes an empty table to an empty one, carries further columns along whatever their names (the last drops
them), and treats each row for itself unless it says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattica.llm.common import freed, read, small_batches, written
from lattica.llm.decontaminate import drop_contaminated
from lattica.llm.jaccard import keep_one
from lattica.llm.mixing import mixed_rows
from lattica.llm.token_store import store_documents
from lattica.llm.toxicity import filter_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold.

    Null and empty texts have the score of the intercept; a null doc_id is no reason to go; repeated rows go or stay
    together, as their texts score alike; a score that equals the threshold goes. Labels are those of sf_dir, whatever docs holds.
    """
    small_batches(spark)
    out = filter_toxic(spark, docs, sf_dir)
    freed()  # what the fit took in the driver
    return out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates.

    Rows are told apart by doc_id and text; a doc_id comes before none, equal ones are ordered by a digest of their texts;
    of rows equal in both one stays. Null and empty texts, and those of white space alone, are in no group and all stay.
    """
    small_batches(spark)
    return keep_one(spark, docs, sf_dir)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none; of rows with one doc_id, or none, only those go whose own text holds an item; repeated
    rows go or stay together; without items all stay.
    """
    small_batches(spark)
    return drop_contaminated(spark, docs, sf_dir)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Null and empty texts have size 0 and are taken as often as their source is taken whole; a null source is a source; a
    null doc_id has a place in the order like any other; repeated rows count each, and so do rows of one doc_id, in the
    order of their sizes.
    """
    return mixed_rows(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, read back from the store.

    Null and empty texts have the end id alone; null doc_ids come last; rows of one doc_id are ordered by a digest of
    their ids, and repeated rows are stored as often as they occur.
    """
    small_batches(spark)
    return store_documents(spark, docs)


STAGES = [("toxicity", toxicity), ("near duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("token ids", token_ids)]

#: SQL can't express the classifier, the edit distances and the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "_"))
    return docs


QUERIES = {"pipeline": run}
SQL = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
