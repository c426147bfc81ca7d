"""The queries of this subpackage, and their SQL."""

from __future__ import annotations

from . import align, bpetree, chaining, covertree, decontaminate, jaccard, katz, langid, licenses, pack, resample, suffixes, toxicity

QUERIES = {
    "op1_suffix_arrays": suffixes.op1_suffix_arrays,
    "op2_cover_tree": covertree.op2_cover_tree,
    "op3_jaccard_join": jaccard.op3_jaccard_join,
    "op4_katz_backoff": katz.op4_katz_backoff,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_collinear_chains": chaining.op6_collinear_chains,
    "op7_language_mixture": langid.op7_language_mixture,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_pack": pack.op9_pack,
    "op10_license_sentences": licenses.op10_license_sentences,
    "op11_token_alignment": align.op11_token_alignment,
    "op12_resample": resample.op12_resample,
    "op13_bpe_tree": bpetree.op13_bpe_tree,
}

SQL = decontaminate.SQL | licenses.SQL | resample.SQL
