"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cellwright.llm import bpe_transducer, chat_format, filter_audit, jaccard_join, license_scan, neighbour_graph, packing, phrase_automata, pseudo_likelihood, simhash_dedup, suffix_dedup, topk_search, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_topk_search": topk_search.op1_topk_search,
        "op2_chat_format": chat_format.op2_chat_format,
        "op3_pseudo_likelihood": pseudo_likelihood.op3_pseudo_likelihood,
        "op4_neighbour_graph": neighbour_graph.op4_neighbour_graph,
        "op5_license_scan": license_scan.op5_license_scan,
        "op6_ngram_jaccard": jaccard_join.op6_ngram_jaccard,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_packing": packing.op8_packing,
        "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
        "op10_bpe_transducer": bpe_transducer.op10_bpe_transducer,
        "op11_simhash_dedup": simhash_dedup.op11_simhash_dedup,
        "op12_phrase_automata": phrase_automata.op12_phrase_automata,
        "op13_filter_audit": filter_audit.op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_topk_search": topk_search.ORACLE,
        "op2_chat_format": chat_format.ORACLE,
        "op6_ngram_jaccard": jaccard_join.ORACLE,
        "op9_suffix_dedup": suffix_dedup.ORACLE,
        "op12_phrase_automata": phrase_automata.ORACLE,
        "op13_filter_audit": filter_audit.ORACLE,
    }
