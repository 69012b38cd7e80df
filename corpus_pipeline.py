"""The corpus pipeline: quality rules, near duplicates, repeated passages, private data, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last
return the columns of ``documents``; ``n_chars`` follows the text.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import packing, pii, quality, simhash, substrings
from ledgerloom.llm.queries import DEMO_KEY
from ledgerloom.llm.rows import unwrapped, wrapped
from ledgerloom.storage import remove, scratch_scope, written

#: Scratch tables by application and sf_dir, then by stage.
_scratch: dict[tuple[str, str], dict[int, list[str]]] = {}


def _stage(index: int):
    """Delete the scratch tables of earlier stages of the same sf_dir, whose results are written by now; note this one's own.

    Tables that ``docs`` still reads stay. Two runs over one sf_dir in one
    application must follow one another; other runs do not meet.
    """

    def decorate(work):
        @wraps(work)
        def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            made_by = _scratch.setdefault((spark.sparkContext.applicationId, sf_dir), {})
            done = [p for i, paths in made_by.items() if i < index for p in paths]
            read = docs.inputFiles() if done else []
            held = {p for p in done if any(p.rsplit("/", 1)[1] in f for f in read)}
            remove(spark, [p for p in done if p not in held])
            for i, paths in made_by.items():
                if i < index:
                    paths[:] = [p for p in paths if p in held]
            with scratch_scope() as made:
                out = work(spark, docs, sf_dir)
            made_by.setdefault(index, []).extend(made)
            return out

        return stage

    return decorate


@_stage(0)
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep, as :func:`quality.judged` says of NULLs, ties, empty tables and small groups.

    All columns stay as they are, whatever their names.
    """
    names = ("text", "lang", "source")
    measured = written(quality.with_statistics(wrapped(docs, *names)), "measured")
    return quality.judged(measured).filter("kept").select(*unwrapped(docs.columns, *names))


@_stage(1)
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of texts whose five-word shingles are similar to 0.8, see :func:`simhash.similar_representatives`."""
    return simhash.similar_representatives(docs)


@_stage(2)
def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document holds; texts that lose nothing stay as they are.

    NULLs, ties, repeated rows and empty tables as :func:`substrings.remove_repeats` has them.
    """
    cut = substrings.remove_repeats(wrapped(docs, "doc_id", "text"))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return cut.select(*_with_text(text, docs.columns, "doc_id"))


@_stage(3)
def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for private data, see :func:`pii.replace`."""
    return pii.replace(wrapped(docs, "text"), DEMO_KEY).select(*_with_text(F.col("text"), docs.columns))


@_stage(4)
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences, see :func:`packing.pack_documents`.

    Workers remember fewer words than in packing alone, as they stand beside a JVM that the stages before have filled.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), remember=48_000_000)


def _with_text(text: Column, columns: list[str], *names: str) -> list[Column]:
    """The columns with the new text, and with n_chars after it."""
    return unwrapped(columns, *names, made={"text": text, "n_chars": F.char_length(text).cast("long")})


STAGES = [
    ("quality rules", quality_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("PII", pii_stage),
    ("packing", packing_stage),
]

#: The outlier estimate, the component search and the packing plan are iterative; the tests hold brute force against them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, "stage")
    return docs
