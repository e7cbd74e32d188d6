"""A pipeline over documents: each stage works on all that its predecessor kept.

toxicity: documents that the network rejects go. near_duplicates: of texts linked by a Jaccard similarity of 0.8 or more
of their five-word shingles the one of smallest doc_id stays; SimHash fingerprints and BK-trees find them, sets of shingles
verify them. decontamination: documents that hold a window of a
benchmark item go. secrets: spans found are overwritten. packing: what is left is packed into sequences, each with the ids
and the text of what it holds.

Null and empty texts pass all stages and are packed as an end alone. A row without an id is judged by its text like any
other. Of rows of one id with equal texts one stays. An empty table gives an empty one, and columns of other names than
those of documents are carried along up to the last stage, whatever they are called."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabloom.llm import decontaminate, packing, secrets, simhash, toxicity
from tabloom.llm._common import shared_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars follows the text where that changed."""
    spans = "secret_spans"
    while spans in docs.columns:
        spans += "_"
    redacted = secrets.redact(secrets.scan(docs, secrets.train(secrets.labelled_samples(spark)), into=spans), column=spans)
    size = F.when(F.size(spans) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return redacted.withColumn("n_chars", size).drop(spans)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.sequences(packing.best_fit(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: No SQL expresses the stages; tests hold each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
