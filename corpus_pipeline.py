"""A corpus pipeline: toxicity, line dedup, near-dedup, mixing, and encoding of ``documents``.

Counted as part of the llm subpackage. Each stage gets what the stage before has written.

Defined results: null texts pass all stages and have no tokens; documents without words are
kept, stand alone and are mixed as their source's rate says (their size counts 0); very
long texts are read whole; of equal texts the smallest doc_id stays; rows that repeat a
doc_id are one document to near-dedup; extra columns are carried up to mixing, whatever
their names; empty tables give an empty result.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riftline.llm import bpe, line_dedup, minhash_dedup, mixing, toxicity
from riftline.llm.common import delete, noted, read, stored


#: What each stage has written on its way, until the next stage runs on that stage's own written result.
_scratch: dict[str, list[str]] = {}


@contextlib.contextmanager
def _after(spark: SparkSession, stage: str, before: str) -> Iterator[None]:
    """Runs a stage; the tables of the stage before, of which the result is written by now, go first."""
    delete(spark, _scratch.pop(before, []))
    with noted() as paths:
        yield
    _scratch.setdefault(stage, []).extend(paths)


#: The columns that stages read; any other is carried.
READ = ("doc_id", "text", "lang", "source", "n_chars")


def _carrying(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A stage's result with the columns of ``docs``. Columns that it doesn't read have names on the way that no stage uses."""
    names = docs.columns
    safe = [c if c in READ else f"carried_{i}" for i, c in enumerate(names)]
    return stage(docs.toDF(*safe)).select(*safe).toDF(*names)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier, learned from the labelled documents, rejects."""
    with _after(spark, "toxicity", ""):
        learned = toxicity.trained(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
        return _carrying(docs, lambda d: toxicity.without_toxic(d, *learned))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that repeat, within one edit, an earlier one; n_chars follows the text."""
    with _after(spark, "line_dedup", "toxicity"):
        out = _carrying(docs, line_dedup.deduped)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    with _after(spark, "near_dedup", "line_dedup"):
        return _carrying(docs, minhash_dedup.keep_one)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents as often as their source's rate says."""
    with _after(spark, "mixing", "near_dedup"):
        return _carrying(docs, mixing.mix)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and digests of the mixed documents."""
    with _after(spark, "encoding", "mixing"):
        return bpe.digests(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: A learned classifier and BPE can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each but the last written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
