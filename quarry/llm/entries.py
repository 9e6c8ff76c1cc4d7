"""The queries of the training-data operators and their SQL; __spark_entry__ adds them."""

from __future__ import annotations

from . import exact_dedup, jaccard_join, licenses, mixing, packing, quality_net, quality_rules, sharding, substring_dedup, toxicity
from .common import table


def op1_substring_dedup(spark, sf_dir):
    return substring_dedup.drop_repeats(table(spark, sf_dir, "documents"))


def op2_quality_net(spark, sf_dir):
    return quality_net.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op4_interleave_shards(spark, sf_dir):
    return sharding.shard_rows(table(spark, sf_dir, "documents"))


def op5_jaccard_join(spark, sf_dir):
    return jaccard_join.jaccard_classes(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_toxicity(spark, sf_dir):
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_license_scan(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op9_mix_sources(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_quality_net, op3_quality_rules, op4_interleave_shards, op5_jaccard_join, op6_best_fit_packing, op7_toxicity, op8_license_scan, op9_mix_sources, op10_exact_dedup)}
ORACLE = {
    "op1_substring_dedup": substring_dedup.SQL,
    "op4_interleave_shards": sharding.SQL,
    "op5_jaccard_join": jaccard_join.SQL,
    "op8_license_scan": licenses.SQL,
    "op9_mix_sources": mixing.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
}
