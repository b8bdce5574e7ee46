"""The registered query of each operator, with production parameters over the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import corpus_pipeline
from pricetide.llm import decontaminate, jaccard, language, lattice, lines, packing, quality, ranked, secret_scan, shards, substring, toxicity, whitening
from pricetide.llm.common import read_table


def op1_quality(spark, sf_dir: str) -> DataFrame:
    return quality.quality(read_table(spark, sf_dir, "documents"))


def op2_substring(spark, sf_dir: str) -> DataFrame:
    return substring.digests(substring.remove(read_table(spark, sf_dir, "documents")))


def op3_language(spark, sf_dir: str) -> DataFrame:
    return language.identify(read_table(spark, sf_dir, "documents"))


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    return secret_scan.scan(read_table(spark, sf_dir, "documents"))


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op6_shards(spark, sf_dir: str) -> DataFrame:
    placed = shards.shard(read_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_packing(spark, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(read_table(spark, sf_dir, "documents")))


def op8_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=4, percent=85)


def op9_lines(spark, sf_dir: str) -> DataFrame:
    return lines.digests(lines.dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    found = toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return found.withColumn("passages", F.size("passages"))


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    found = whitening.whiten(read_table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").cast("long"))


def op12_ranked(spark, sf_dir: str) -> DataFrame:
    return ranked.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_lattice(spark, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(read_table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


_QUERIES = (
    op1_quality,
    op2_substring,
    op3_language,
    op4_secrets,
    op5_decontamination,
    op6_shards,
    op7_packing,
    op8_jaccard,
    op9_lines,
    op10_toxicity,
    op11_whitening,
    op12_ranked,
    op13_lattice,
)
REGISTRY: dict[str, Callable] = {f.__name__: f for f in _QUERIES}
REGISTRY["pipeline"] = corpus_pipeline.run
ORACLES: dict[str, str] = {"op1_quality": quality.sql(), "op12_ranked": ranked.sql(), "op13_lattice": lattice.sql()}
