"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from placeloom.llm import bpe, filters, lines, lm, merkle, packing, simhash, substring, tiff, token_counts, topk, toxicity, warc

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_tiff": tiff.op2_tiff,
    "op3_packing": packing.op3_packing,
    "op4_lm": lm.op4_lm,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_substring": substring.op7_substring,
    "op8_topk": topk.op8_topk,
    "op9_warc": warc.op9_warc,
    "op10_bpe": bpe.op10_bpe,
    "op11_merkle": merkle.op11_merkle,
    "op12_lines": lines.op12_lines,
    "op13_filters": filters.op13_filters,
}

ORACLE_SQL = {
    "op7_substring": substring.OP7_SQL,
    "op8_topk": topk.OP8_SQL,
    "op9_warc": warc.OP9_SQL,
    "op11_merkle": merkle.OP11_SQL,
    "op12_lines": lines.OP12_SQL,
    "op13_filters": filters.OP13_SQL,
}
