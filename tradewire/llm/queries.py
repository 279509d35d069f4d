"""The queries of this subpackage, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tradewire.llm import bpe, decontaminate, language, neighbours, secrets, shards, simhash, substring, suffix, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": bpe.op1,
        "op2_suffix_dedup": suffix.op2,
        "op3_substring_dedup": substring.op3,
        "op4_secrets": secrets.op4,
        "op5_decontamination": decontaminate.op5,
        "op6_language": language.op6,
        "op7_sharding": shards.op7,
        "op8_simhash": simhash.op8,
        "op9_url_filters": urls.op9,
        "op10_neighbours": neighbours.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_suffix_dedup": suffix.OP2_SQL, "op3_substring_dedup": substring.OP3_SQL, "op5_decontamination": decontaminate.OP5_SQL, "op9_url_filters": urls.OP9_SQL}
