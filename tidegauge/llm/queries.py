"""The registered queries of the corpus operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from importlib import import_module

from tidegauge.llm.fixity import OP4_SQL
from tidegauge.llm.interactions import OP11_SQL
from tidegauge.llm.repair import OP12_SQL
from tidegauge.llm.subtrees import OP13_SQL
from tidegauge.llm.suffixes import OP5_SQL
from tidegauge.llm.urls import OP2_SQL


def _tables(spark, sf_dir, *names):
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def _query(module, function, *tables):
    def run(spark, sf_dir):
        operator = getattr(import_module(f"tidegauge.llm.{module}"), function)
        return operator(*_tables(spark, sf_dir, *tables))

    run.__name__ = function
    return run


QUERIES = {
    "op1_collision_search": _query("ann", "op1", "embeddings"),
    "op2_url_filter": _query("urls", "op2", "pages"),
    "op3_merge_dropout": _query("pieces", "op3", "documents"),
    "op4_fixity_audit": _query("fixity", "op4", "pages"),
    "op5_suffix_dedup": _query("suffixes", "op5", "documents"),
    "op6_simhash_copies": _query("simhash", "op6", "documents"),
    "op7_quality_rules": _query("rules", "op7", "documents", "labels"),
    "op8_source_mix": _query("mixing", "op8", "documents"),
    "op9_token_counts": _query("tokens", "op9", "documents"),
    "op10_shards": _query("shards", "op10", "documents"),
    "op11_filter_audit": _query("interactions", "op11", "documents", "labels"),
    "op12_conversation_repair": _query("repair", "op12", "conversations"),
    "op13_subtree_dedup": _query("subtrees", "op13", "documents"),
}

ORACLE_SQL: dict[str, str] = {"op2_url_filter": OP2_SQL, "op4_fixity_audit": OP4_SQL, "op5_suffix_dedup": OP5_SQL, "op11_filter_audit": OP11_SQL, "op12_conversation_repair": OP12_SQL, "op13_subtree_dedup": OP13_SQL}
