"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import balltree, bpe, infill, jaccard, langid_crf, licenses, mixing, mpegts, oneperm, quality_cnn, secrets, tokencount, vptree
from .common import table


def op1_langid_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid_crf.op1(table(spark, sf_dir, "documents"))


def op2_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op2(table(spark, sf_dir, "documents"))


def op5_mixing_ipf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op5(table(spark, sf_dir, "documents"))


def op6_vantage_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.op6(table(spark, sf_dir, "embeddings"))


def op7_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.op7(table(spark, sf_dir, "documents"))


def op3_jaccard_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.op3(table(spark, sf_dir, "documents"))


def op4_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.op4(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.op8(table(spark, sf_dir, "documents"))


def op9_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpegts.stored_texts(table(spark, sf_dir, "documents"), with_points=True)


def op10_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cnn.op10(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.op11(table(spark, sf_dir, "documents"))


def op12_one_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oneperm.op12(table(spark, sf_dir, "documents"))


def op13_ball_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balltree.op13(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_langid_crf,
        op2_secret_ownership,
        op3_jaccard_paths,
        op4_bpe_chunks,
        op5_mixing_ipf,
        op6_vantage_trees,
        op7_license_dice,
        op8_token_counts,
        op9_transport_streams,
        op10_quality_cnn,
        op11_fill_in_middle,
        op12_one_permutation,
        op13_ball_trees,
    )
}
ORACLES: dict[str, str] = {
    "op2_secret_ownership": secrets.SQL,
    "op5_mixing_ipf": mixing.sql(),
    "op11_fill_in_middle": infill.SQL,
    "op13_ball_trees": balltree.sql(),
}
