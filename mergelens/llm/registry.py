"""The queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from . import bpe, collocations, fingerprint, language, lexical, licences, near, packing, pieces, quality, repeats, tokenfile, topk

QUERIES = {
    "op1_fingerprint": fingerprint.op1_fingerprint,
    "op2_topk": topk.op2_topk,
    "op3_licences": licences.op3_licences,
    "op4_bpe": bpe.op4_bpe,
    "op5_packing": packing.op5_packing,
    "op6_quality": quality.op6_quality,
    "op7_token_file": tokenfile.op7_token_file,
    "op8_near_duplicates": near.op8_near_duplicates,
    "op9_repeats": repeats.op9_repeats,
    "op10_language": language.op10_language,
    "op11_sentencepiece": pieces.op11_sentencepiece,
    "op12_lexical": lexical.op12_lexical,
    "op13_collocations": collocations.op13_collocations,
}
ORACLE = {"op2_topk": topk.ORACLE, "op12_lexical": lexical.ORACLE, "op13_collocations": collocations.ORACLE}
