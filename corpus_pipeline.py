"""The corpus pipeline: quality, toxicity, near-duplicates, decontamination, then pieces. Part of the llm subpackage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewheel.llm.decontaminate import drop_contaminated
from tidewheel.llm.ngram_join import keep_one_of_each
from tidewheel.llm.pieces import encode_decode
from tidewheel.llm.queries import _digests
from tidewheel.llm.quality import keep_quality
from tidewheel.llm.shared import stash, table, unstash
from tidewheel.llm.toxicity import drop_toxic


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_quality(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, table(spark, sf_dir, "labels"), threshold=0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of each group of links stays."""
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with any hit word go, however long their text is: a passage of the benchmark in a long text leaks as much."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"), percent=0)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of ids and of the decoded text, bytes covered by the pieces' spans."""
    return encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"], _digests, "n_tokens long, ids_sha256 string, decoded_sha256 string, bytes_covered long")


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("pieces", pieces)]

#: Trained models decide in the first stages; tests hold each stage's rows against its operator's verdicts or brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash(docs, name)
            if before is not None:
                unstash(before)
            before = docs
    return docs
