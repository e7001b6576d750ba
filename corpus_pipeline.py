"""Documents to packed training pieces: four stages, each over all rows its predecessor kept.

All stages take null and empty texts, null and repeated ids, repeated rows, ties,
very long texts, empty tables and further columns; what each makes of them is
said there. All but the last return the columns of ``docs``, whatever they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagechron.llm.common import read, stage
from pagechron.llm.decontaminate import without_benchmark
from pagechron.llm.encoding import vocabulary
from pagechron.llm.near_copies import without_near_copies
from pagechron.llm.packing import pack_documents
from pagechron.llm.queries import BYTE_VOCABULARY
from pagechron.llm.toxicity import ordinary_documents


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go.

    Null and empty texts score as texts without evidence and stay unless most
    labelled rows are toxic; rows of one text go or stay together, with or
    without an id; without labels of both classes nothing is learnt and all rows
    have the same score; an empty table stays empty.
    """
    return ordinary_documents(docs, read(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays.

    Null and empty texts, and texts without words, are copies of each other;
    repeated rows of the id that stays all stay; rows without an id stay or go together:
    they stay if any of them is in a group without a known id; an empty table stays empty.
    """
    return without_near_copies(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none, null and empty items are held by none; rows
    of one text go or stay together; an empty benchmark drops nothing; an empty
    table stays empty.
    """
    return without_benchmark(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, packed into windows of token ids.

    Null and empty texts are the end id alone; repeated rows and rows without an
    id are packed like others; an empty table gives no pieces.
    """
    return pack_documents(docs, vocabulary(BYTE_VOCABULARY), end_id=1)


STAGES = [("toxicity", drop_toxic), ("simhash_near_dedup", drop_near_copies), ("decontamination", drop_benchmark), ("packing", pack)]

#: SQL cannot express these stages (models, hashes, token ids); tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES, 1):
        docs = step(spark, docs, sf_dir)
        docs = stage(docs, name) if k < len(STAGES) else docs
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
