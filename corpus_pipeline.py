"""The corpus pipeline: five stages over the documents, each written and read again before the next.

1. quality classifier: documents that the byte network rejects go.
2. n-gram Jaccard join: of each class of near duplicates the document with the smallest doc_id stays.
3. secret scans: live-looking credentials are replaced in the text; copied examples and all documents stay.
4. mixing: documents are sampled to the raked target weights of sources, languages and text forms.
5. BPE: the sampled texts are encoded and decoded; the result has a row for each.

All but the last stage return the columns of the documents they get, whatever columns those are.

Defined cases, in each stage those of its operator: null and empty texts are scored like any text, have no near duplicates and
no secrets, and encode to no ids; repeated rows are one class, of which one row stays; rows with a null id go through every
stage; long texts are handled whole; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import bpe, jaccard, mixing, quality_cnn, secrets
from weftline.llm.common import shared_folder, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The classifier learns from the labelled rows of the tables in sf_dir, and decides on docs."""
    model = quality_cnn.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_cnn.kept(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class stays, as it is; rows without a near duplicate all stay."""
    return jaccard.one_of_each(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay; of texts with live-looking values these are cut out, and n_chars is set anew."""
    return secrets.redacted(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that are drawn by calibrated probabilities, as they are."""
    return mixing.sampled(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text, and the ids themselves."""
    got = bpe.encoded(docs)
    return bpe.digests(got, keep=("doc_id", "ids"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("secret_scans", secret_scans),
    ("mixture", mixture),
    ("encode", encode),
]

#: SQL can't express the network, the join's sets in bounded time or the tokenizer; tests compare with plain Python.
ORACLE_SQL = None


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents; each stage's rows are written to the shared folder and read again.

    A stage's folder is deleted when the next one is written; the last one's is the result's and stays.
    """
    base, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            _delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
