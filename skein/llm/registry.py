"""Queries of this subpackage and, where SQL can say them, their DuckDB SQL."""

from . import bpe, decontaminate, katz, language, licenses, merkle, neardup, quality, records, secrets

QUERIES = {
    "op1_quality_rules": quality.query,
    "op2_warc_merkle_audit": merkle.query,
    "op3_language_id": language.query,
    "op4_secret_scans": secrets.query,
    "op5_decontamination": decontaminate.query,
    "op6_byte_bpe": bpe.query,
    "op7_token_records": records.query,
    "op8_minhash_near_dedup": neardup.query,
    "op9_katz_lm": katz.query,
    "op10_license_scans": licenses.query,
}
ORACLES = {"op2_warc_merkle_audit": merkle.SQL, "op5_decontamination": decontaminate.SQL}
