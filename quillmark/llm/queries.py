"""Registered queries of the training-data operators, and their SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import op5_ann
from .chat import op2_chat
from .filter_audit import OP11_SQL, op11_filter_audit
from .html_text import op10_html_text
from .metric_search import OP9_SQL, op9_metric_search
from .mixing import OP3_SQL, op3_mixing
from .near_dup import op8_near_dup
from .packing import op1_packing
from .quality import op6_quality
from .sharding import op13_sharding
from .spelling import op12_spelling
from .token_store import op4_token_store
from .toxicity import op7_toxicity


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_packing, op2_chat, op3_mixing, op4_token_store, op5_ann, op6_quality, op7_toxicity, op8_near_dup, op9_metric_search, op10_html_text,
             op11_filter_audit, op12_spelling, op13_sharding]
    from corpus_pipeline import run as pipeline

    return {f.__name__: f for f in found} | {"pipeline": pipeline}


def llm_oracles() -> dict[str, str]:
    from corpus_pipeline import ORACLE_SQL

    found = {"op3_mixing": OP3_SQL, "op9_metric_search": OP9_SQL, "op11_filter_audit": OP11_SQL, "pipeline": ORACLE_SQL}
    return {k: v for k, v in found.items() if v}
