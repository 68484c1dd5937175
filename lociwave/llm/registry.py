"""The queries of this subpackage and the DuckDB statements of those that have one."""

from . import ann, binary, bpe, importance, langid, lexical, licences, lines, mixing, neardup, quality, topk, warc

QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_byte_bpe": bpe.op2_byte_bpe,
    "op3_minhash_dedup": neardup.op3_minhash_dedup,
    "op4_mixing": mixing.op4_mixing,
    "op5_feistel_shards": binary.op5_feistel_shards,
    "op6_quality_mil": quality.op6_quality_mil,
    "op7_license_scan": licences.op7_license_scan,
    "op8_exact_topk": topk.op8_exact_topk,
    "op9_warc": warc.op9_warc,
    "op10_multiprobe_lsh": ann.op10_multiprobe_lsh,
    "op11_impact_search": lexical.op11_impact_search,
    "op12_crc_importance": importance.op12_crc_importance,
    "op13_line_crf": lines.op13_line_crf,
}
ORACLES = {
    "op3_minhash_dedup": neardup.OP3_SQL,
    "op7_license_scan": licences.OP7_SQL,
    "op8_exact_topk": topk.OP8_SQL,
    "op9_warc": warc.OP9_SQL,
    "op11_impact_search": lexical.OP11_SQL,
    "op12_crc_importance": importance.OP12_SQL,
}
