"""Queries of the operators for training text: one for each, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, hostrules, langid, licenses, linetemplates, mixing, nbsvm, neardup, negatives, packing, phrases, substring, unigram
from .common import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_language_id": lambda s, d: langid.op1_language_id(table(s, d, "documents")),
    "op2_substring_dedup": lambda s, d: substring.op2_substring_dedup(table(s, d, "documents")),
    "op3_license_scan": lambda s, d: licenses.op3_license_scan(table(s, d, "documents")),
    "op4_line_templates": lambda s, d: linetemplates.op4_line_templates(table(s, d, "documents")),
    "op5_hilbert_packing": lambda s, d: packing.op5_hilbert_packing(table(s, d, "documents")),
    "op6_host_quality_rules": lambda s, d: hostrules.op6_host_quality_rules(table(s, d, "documents")),
    "op7_token_counts": lambda s, d: unigram.op7_token_counts(table(s, d, "documents")),
    "op8_minhash_near_dedup": lambda s, d: neardup.op8_minhash_near_dedup(table(s, d, "documents")),
    "op9_quality_classifier": lambda s, d: nbsvm.op9_quality_classifier(table(s, d, "documents"), table(s, d, "labels")),
    "op10_benchmark_decontamination": lambda s, d: decontam.op10_benchmark_decontamination(table(s, d, "documents"), table(s, d, "benchmark")),
    "op11_source_mixing": lambda s, d: mixing.op11_source_mixing(table(s, d, "documents")),
    "op12_phrase_collocations": lambda s, d: phrases.op12_phrase_collocations(table(s, d, "documents")),
    "op13_hard_negatives": lambda s, d: negatives.op13_hard_negatives(table(s, d, "embeddings")),
}

ORACLES: dict[str, str] = {
    "op2_substring_dedup": substring.OP2_SQL,
    "op3_license_scan": licenses.OP3_SQL,
    "op6_host_quality_rules": hostrules.OP6_SQL,
    "op8_minhash_near_dedup": neardup.OP8_SQL,
    "op10_benchmark_decontamination": decontam.OP10_SQL,
    "op11_source_mixing": mixing.OP11_SQL,
    "op12_phrase_collocations": phrases.OP12_SQL,
    "op13_hard_negatives": negatives.OP13_SQL,
}
