"""Queries and oracle SQL of this subpackage, by name."""

from __future__ import annotations

from orbweave.llm import bpe, chat, collocations, hard_negatives, langid, line_dedup, lm, media, mixing, ngram_join, quality, spotsigs, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_ngram_jaccard": ngram_join.op2_ngram_jaccard,
    "op3_audio": media.op3_audio,
    "op4_pseudo_likelihood": lm.op4_pseudo_likelihood,
    "op5_byte_bpe": bpe.op5_byte_bpe,
    "op6_langid": langid.op6_langid,
    "op7_spotsigs": spotsigs.op7_spotsigs,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_quotes": chat.op9_quotes,
    "op10_mix": mixing.op10_mix,
    "op11_quality": quality.op11_quality,
    "op12_collocations": collocations.op12_collocations,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
    "spotsigs_near_duplicates": spotsigs.spotsigs_near_duplicates,
}

ORACLES: dict[str, str] = {
    "op1_warc": warc.ORACLE,
    "op2_ngram_jaccard": ngram_join.ORACLE,
    "op7_spotsigs": spotsigs.ORACLE,
    "op8_line_dedup": line_dedup.ORACLE,
    "op9_quotes": chat.ORACLE,
    "op10_mix": mixing.ORACLE,
    "op12_collocations": collocations.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
    "spotsigs_near_duplicates": spotsigs.NEAR_ORACLE,
}
