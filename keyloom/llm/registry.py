"""Queries of the text operators and the SQL that states their results, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keyloom.llm import quality_rules
from keyloom.llm.fingerprints import op6_fingerprints
from keyloom.llm.jaccard_join import OP2_SQL, op2_jaccard_join
from keyloom.llm.mixing import op5_mix_sources
from keyloom.llm.packing import op7_pack_sequences
from keyloom.llm.quality_classifier import op10_quality_classifier
from keyloom.llm.quality_rules import op4_quality_rules
from keyloom.llm.repeats import OP1_SQL, op1_suffix_dedup
from keyloom.llm.token_shards import op8_token_shards
from keyloom.llm.toxicity import op3_toxicity
from keyloom.llm.url_filter import OP9_SQL, op9_url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_suffix_dedup, op2_jaccard_join, op3_toxicity, op4_quality_rules, op5_mix_sources, op6_fingerprints, op7_pack_sequences, op8_token_shards, op9_url_filter, op10_quality_classifier]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_dedup": OP1_SQL, "op2_jaccard_join": OP2_SQL, "op4_quality_rules": quality_rules.oracle(), "op9_url_filter": OP9_SQL}
