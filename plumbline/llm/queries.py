"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm import (
    collocations, decontaminate, line_dedup, mixing, secret_scan, sharding, simhash, span_dedup, suffix_dedup, topk, toxicity, warc,
    whitening,
)

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_mix_sources(spark, sf):
    counts = mixing.mixed_counts(table(spark, sf, "documents"))
    every_row = counts.withColumn("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows"))))
    return every_row.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


@query
def op2_decontaminate(spark, sf):
    return decontaminate.contamination_table(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op3_secrets(spark, sf):
    return secret_scan.secret_table(table(spark, sf, "documents"))


@query
def op4_suffix_dedup(spark, sf):
    return suffix_dedup.suffix_table(table(spark, sf, "documents"))


@query
def op5_span_dedup(spark, sf):
    return span_dedup.span_table(table(spark, sf, "documents"))


@query
def op6_simhash(spark, sf):
    return simhash.simhash_table(table(spark, sf, "documents"))


@query
def op7_toxicity(spark, sf):
    return toxicity.toxicity_table(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op8_top_products(spark, sf):
    return topk.embedding_neighbours(table(spark, sf, "embeddings"))


@query
def op9_warc(spark, sf):
    return warc.round_trip(table(spark, sf, "pages"))


@query
def op10_shards(spark, sf):
    return sharding.shard_table(table(spark, sf, "documents"), 40)


@query
def op11_line_dedup(spark, sf):
    return line_dedup.line_table(table(spark, sf, "documents"))


@query
def op12_collocations(spark, sf):
    return collocations.collocations(table(spark, sf, "documents"))


@query
def op13_whitening(spark, sf):
    return whitening.whitening_table(table(spark, sf, "embeddings"))
