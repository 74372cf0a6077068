"""The corpus pipeline: documents to packed sequences in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a DataFrame that is written as Parquet
and reread as the next one's docs. All but the last return the columns of documents; the last returns the
packed pieces with their token ids.

Work tables go when they have served: a stage removes those that the stage before it left in this thread, whose result is written
by then (tables that docs itself still reads stay), so the disk holds one stage's work at a time. A result of one of the first four stages
that wasn't written can't be read after the next stage was called. The last stage's tables stay for its reader.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import documents, shielded, stored
from lodestar.llm.line_dedup import line_dedup
from lodestar.llm.near_dedup import keep_one
from lodestar.llm.packing import pack
from lodestar.llm.pii import redact
from lodestar.llm.quality_rules import quality_rules
from lodestar.sources.shared import drop_tables, recorded

#: Hashes and boosted trees have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


_left = threading.local()


def _frees(before: str, keeps: bool = False) -> Callable:
    """A stage that removes the work tables which the stage called ``before`` left, and notes its own, unless it keeps them."""

    def made(stage):
        @wraps(stage)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            drop_tables(spark, vars(_left).pop(before, []), docs)
            with recorded() as paths:
                out = stage(spark, docs, sf_dir)
            if not keeps:
                setattr(_left, stage.__name__, paths)
            return out

        return run_stage

    return made


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Verdicts travel in the rows they judge, so no join is needed."""
    return shielded(docs, lambda df: quality_rules(df, carried=df.columns).where("kept"))


@_frees("quality_stage")
def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated runs of lines; documents of which nothing is left go."""
    return _counted(shielded(docs, lambda df: line_dedup(df, drop_emptied=True)))


@_frees("line_stage")
def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, 80 percent."""
    return shielded(docs, keep_one)


@_frees("near_stage")
def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced."""
    return _counted(shielded(docs, redact))


@_frees("pii_stage", keeps=True)
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of 4096 tokens, with the token ids."""
    return pack(docs, with_ids=True)


STAGES = [
    ("op1_quality_rules", quality_stage),
    ("op4_line_dedup", line_stage),
    ("op9_near_dedup", near_stage),
    ("op10_pii", pii_stage),
    ("op2_best_fit_packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between two stages is a table in the shared folder, which goes once its successor is written."""
    docs, served = documents(spark, sf_dir), []
    for name, stage in STAGES[:-1]:
        with recorded() as written:
            result = stage(spark, docs, sf_dir)
            work = len(written)
            docs = stored(result, f"stage-{name}")
        drop_tables(spark, served, docs)
        served = written[work:]
    return STAGES[-1][1](spark, docs, sf_dir)
