"""The queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scanweave.llm import oracles
from scanweave.llm.centroids import op13_centroids
from scanweave.llm.classifier import op7_classifier
from scanweave.llm.decontam import op11_decontaminate
from scanweave.llm.licenses import op9_licenses
from scanweave.llm.mixing import op3_mix
from scanweave.llm.neardup import op1_minhash
from scanweave.llm.packing import op5_best_fit
from scanweave.llm.ranked import op12_ranked
from scanweave.llm.rules import op8_quality_rules
from scanweave.llm.secrets import op2_secrets
from scanweave.llm.separators import op4_token_counts
from scanweave.llm.topk import op10_topk
from scanweave.llm.wavelet import op6_wavelet


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_minhash": op1_minhash, "op2_secrets": op2_secrets, "op3_mix": op3_mix, "op4_token_counts": op4_token_counts, "op5_best_fit": op5_best_fit, "op6_wavelet": op6_wavelet, "op7_classifier": op7_classifier, "op8_quality_rules": op8_quality_rules, "op9_licenses": op9_licenses, "op10_topk": op10_topk, "op11_decontaminate": op11_decontaminate, "op12_ranked": op12_ranked, "op13_centroids": op13_centroids}


def oracle_sql() -> dict[str, str]:
    return {"op2_secrets": oracles.OP2, "op9_licenses": oracles.OP9, "op10_topk": oracles.OP10, "op11_decontaminate": oracles.OP11, "op12_ranked": oracles.OP12, "op13_centroids": oracles.OP13}
