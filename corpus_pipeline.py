"""The corpus pipeline: language ID, exact dedup, near-dedup, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.

- language_id: rows whose language can't be told (null, no letter) or whose
  cross-entropy is outside the calibrated range go.
- exact_dedup: of equal texts the row with the largest doc_id stays.
- near_dedup: SimHash fingerprints of five-word shingles find candidates by pigeonring
  chains; those with a Jaccard similarity of at least 0.8, taken exactly, are linked.
  Of each component the row with the smallest doc_id stays (rows without one only if
  the component has no other).
- packing: the texts' tokens in sequences of at most 2048.

Nulls: a null text has no language and goes at the first stage; other columns may be
null. Empty tables give empty results. Texts of any length are read whole. Repeated
rows are copies, of which exact_dedup keeps one; ties go by doc_id, then by the text's
hash. Extra columns, whatever their names, pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearvote.llm import blocknames, langid, packing, simhash
from nearvote.llm.common import any_repeated, keep_rows, materialise
from nearvote.llm.resources import pattern, vocabulary


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    told = langid.predict(docs, langid.fit(docs))
    return told.where(~F.col(langid.added_names(docs)[2])).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = blocknames.exact_duplicates(docs)
    return keep_rows(docs, found.where("kept"), any_repeated(found))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = simhash.similar(docs, width=5, similarity=(4, 5))
    return keep_rows(docs, simhash.kept(found), any_repeated(found))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), pattern(), end_id=1)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("packing", pack)]

#: Language models, fingerprints and tokenizers are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
