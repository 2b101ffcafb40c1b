"""The registered queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinspan.llm.decontamination import op4_decontamination
from kinspan.llm.exact_dedup import OP3_SQL, op3_exact_dedup
from kinspan.llm.language_id import op2_language_id
from kinspan.llm.minhash_dedup import op5_minhash_dedup
from kinspan.llm.mixing import OP6_SQL, op6_mixing
from kinspan.llm.quality import op8_quality
from kinspan.llm.secret_scan import op10_secret_scan
from kinspan.llm.suffix_dedup import op7_suffix_dedup
from kinspan.llm.token_counts import op9_token_counts
from kinspan.llm.toxicity import op1_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_language_id": op2_language_id,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_decontamination": op4_decontamination,
        "op5_minhash_dedup": op5_minhash_dedup,
        "op6_mixing": op6_mixing,
        "op7_suffix_dedup": op7_suffix_dedup,
        "op8_quality": op8_quality,
        "op9_token_counts": op9_token_counts,
        "op10_secret_scan": op10_secret_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": OP3_SQL, "op6_mixing": OP6_SQL}
