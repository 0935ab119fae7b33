"""Quality classifier: gradient-boosted trees over statistics of the document."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidewheel.llm.boosting import Trees, fit
from tidewheel.llm.docstats import NAMES, labelled, with_statistics
from tidewheel.llm.shared import fold

#: Labelled rows that training reads at most; each is len(NAMES) floats on the driver.
MAX_LABELLED = 12_000


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MAX_LABELLED) -> Trees:
    def rows(batches):
        for b, x in with_statistics(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(NAMES)).cast(pa.list_(pa.float32()))], ["doc_id", "y", "x"])

    got = labelled(docs, labels, label, most).select("doc_id", "y", "text").mapInArrow(rows, "doc_id long, y int, x array<float>").toPandas().sort_values(["doc_id", "y"], kind="stable")
    return fit(np.array(got.x.tolist(), np.float32).reshape(-1, len(NAMES)), got.y.to_numpy(np.float64))


def scored(docs: DataFrame, model, features=with_statistics, keep: tuple[str, ...] | list[str] = ("doc_id",)) -> DataFrame:
    """Columns `keep` of docs, then score__ from `text` alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        for b, x in features(batches):
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), pa.array(shared.value.score(x))], [*keep, "score__"])

    return docs.mapInArrow(rows, StructType([*(docs.schema[c] for c in keep), StructField("score__", DoubleType())]))


def kept(docs: DataFrame, model, wanted, features=with_statistics) -> DataFrame:
    """The rows of docs for whose score `wanted` holds, with their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        for b, x in features(batches):
            yield b.filter(pa.array(wanted(shared.value.score(x)), pa.bool_()))

    return docs.mapInArrow(rows, docs.schema)


def verdicts(scores: DataFrame, threshold: float) -> DataFrame:
    return scores.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("score__").alias("score"), (F.col("score__") >= threshold).cast("int").alias("predicted"))


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = MAX_LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs(doc_id, text).

    Learns from labels outside fold 0 of crc32(doc_id) mod 5. Null and empty texts get the score of a text without
    any byte; repeated rows score alike; without labels every score is 0.5, and an empty table gives
    no rows. Other columns are ignored."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return verdicts(scored(docs, train(docs, labels, most=most), keep=["doc_id"]), threshold)


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = MAX_LABELLED) -> DataFrame:
    """The rows of docs that the classifier does not reject, with their columns; null texts are judged as empty ones, repeated
    rows alike."""
    return kept(docs, train(docs, labels, most=most), lambda score: score >= threshold)
