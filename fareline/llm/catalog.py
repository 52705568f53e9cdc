"""The registered queries of the subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from fareline.llm import (
    alignment,
    archives,
    exact_copies,
    languages,
    near_copies,
    nearest,
    packing,
    passages,
    personal_data,
    pieces,
    prefix_trie,
    quality,
    swap_packing,
)

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = [pieces, passages, quality, near_copies, personal_data, exact_copies, languages, archives, packing, nearest, prefix_trie, swap_packing, alignment]


def queries() -> dict[str, Query]:
    return {m.NAME: m.query for m in _MODULES} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    twins = {m.NAME: m.ORACLE for m in _MODULES} | {"pipeline": corpus_pipeline.ORACLE_SQL}
    return {name: sql for name, sql in twins.items() if sql is not None}
