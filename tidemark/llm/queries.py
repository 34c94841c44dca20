"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import collocations, lexical, licenses, media, packing, pii, quality, rans, sentencepieces, simhash, suffixes, superminhash, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_topk": topk.op1_exact_topk,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_media": media.op3_media,
    "op4_pii": pii.op4_pii,
    "op5_simhash_near_dedup": simhash.op5_simhash_near_dedup,
    "op6_packing": packing.op6_packing,
    "op7_rans_token_file": rans.op7_rans_token_file,
    "op8_suffix_dedup": suffixes.op8_suffix_dedup,
    "op9_quality": quality.op9_quality,
    "op10_sentencepiece": sentencepieces.op10_sentencepiece,
    "op11_lexical_search": lexical.op11_lexical_search,
    "op12_superminhash_near_dedup": superminhash.op12_superminhash_near_dedup,
    "op13_collocations": collocations.op13_collocations,
}

ORACLES: dict[str, str] = {
    "op1_exact_topk": topk.OP1_SQL,
    "op11_lexical_search": lexical.OP11_SQL,
    "op12_superminhash_near_dedup": superminhash.OP12_SQL,
    "op13_collocations": collocations.OP13_SQL,
}
