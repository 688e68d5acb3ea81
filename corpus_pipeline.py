"""The corpus pipeline: five of the training-data operators, one after the other.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import decontam, langid, neardup, packing, surrogates
from quillgraph.llm.common import cut, fresh, table

#: Under this calibrated probability a language is not believed.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language that the model knows; others go, among them null and empty texts.

    Columns of docs stay as they are, whatever their names; repeated rows are judged each.
    """
    pred, score = fresh(docs.columns, "lang_pred"), fresh(docs.columns, "score")
    found = langid.predict(docs, *langid.fit(docs), names=(pred, score))
    kept = found.where((F.col(pred) != langid.UNDETERMINED) & (F.col(score) >= LEAST_SCORE))
    return kept.select(*[f"`{c}`" for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class; texts without words are classes of their own."""
    return neardup.kept_documents(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark's windows leave clean; null and empty texts are, and all if there is no benchmark."""
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates in place of personal data; n_chars follows the text, a null text stays null."""
    done = surrogates.swapped(docs, None, None)
    return done.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its sequence and place; a null or empty text is one piece, its end mark."""
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pii", pii), ("pack", pack)]

#: SQL cannot express trained, sketched and keyed stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, name)
    return docs
