"""The queries of this subpackage and the SQL that says the same, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from edgeloom.llm import bpe, chat, divergence, langid, license, lm, packing, quality, simhash, structure, subword, topk, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        bpe.op1_bpe_chunk_reuse,
        packing.op2_vector_best_fit,
        topk.op3_tiled_topk,
        quality.op4_decision_list,
        toxicity.op5_classifier_chain,
        lm.op6_causal_attention,
        license.op7_paragraph_classifier,
        chat.op8_token_assembly,
        simhash.op9_byte_position_index,
        langid.op10_string_kernel,
        divergence.op11_radix_tries,
        subword.op12_subword_embeddings,
        structure.op13_structure_fold,
    )
}

ORACLES: dict[str, str] = {"op3_tiled_topk": topk.OP3_SQL, "op8_token_assembly": chat.OP8_SQL, "op11_radix_tries": divergence.OP11_SQL, "op13_structure_fold": structure.OP13_SQL}
