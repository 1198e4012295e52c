"""Queries and SQL of this subpackage."""

from __future__ import annotations

from . import collocations, gbt, html_extract, langid, mixing, neardup, packing, rules, sharding, substring, topk, variants, warc


def queries() -> dict:
    return {
        "op1_balanced_sharding": sharding.op1_balanced_sharding,
        "op2_quality_rules": rules.op2_quality_rules,
        "op3_hyperminhash_neardup": neardup.op3_hyperminhash_neardup,
        "op4_mixing": mixing.op4_mixing,
        "op5_substring_dedup": substring.op5_substring_dedup,
        "op6_bit_sliced_topk": topk.op6_bit_sliced_topk,
        "op7_html_extraction": html_extract.op7_html_extraction,
        "op8_quality_classifier": gbt.op8_quality_classifier,
        "op9_warc": warc.op9_warc,
        "op10_best_fit_packing": packing.op10_best_fit_packing,
        "op11_language_id": langid.op11_language_id,
        "op12_spelling_variants": variants.op12_spelling_variants,
        "op13_collocations": collocations.op13_collocations,
    }


def oracle_sql() -> dict:
    return {
        "op3_hyperminhash_neardup": neardup.OP3_SQL,
        "op4_mixing": mixing.OP4_SQL,
        "op5_substring_dedup": substring.OP5_SQL,
        "op6_bit_sliced_topk": topk.OP6_SQL,
        "op9_warc": warc.OP9_SQL,
        "op12_spelling_variants": variants.OP12_SQL,
        "op13_collocations": collocations.OP13_SQL,
    }
