"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, cotrain, decontaminate, fingerprints, language_id, licenses, line_dedup, lm, ngram_join, warc

QUERIES = {
    "op1_ngram_jaccard_join": ngram_join.op1_ngram_jaccard_join,
    "op6_byte_bpe": bpe.op6_byte_bpe,
    "op7_language_id": language_id.op7_language_id,
    "op8_lm_scoring": lm.op8_lm_scoring,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_quality_cotraining": cotrain.op10_quality_cotraining,
    "op2_warc_revisits": warc.op2_warc_revisits,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_fingerprints": fingerprints.op4_fingerprints,
    "op5_license_scan": licenses.op5_license_scan,
}
ORACLE_SQL = {
    "op2_warc_revisits": warc.OP2_SQL,
    "op3_line_dedup": line_dedup.OP3_SQL,
    "op5_license_scan": licenses.op5_sql(),
}
