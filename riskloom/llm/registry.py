"""Queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from . import bpe, counts, decontaminate, fingerprint, grammar, language, minhash, quality, secrets, simhash, substring, variants, whitening

QUERIES = {
    "op1_secret_scan": secrets.query,
    "op2_substring_dedup": substring.query,
    "op3_quality": quality.query,
    "op4_simhash": simhash.query,
    "op5_repair_ids": grammar.query,
    "op6_token_counts": counts.query,
    "op7_decontamination": decontaminate.query,
    "op8_language": language.query,
    "op9_byte_bpe": bpe.query,
    "op10_fingerprint": fingerprint.query,
    "op11_whitening": whitening.query,
    "op12_minhash": minhash.query,
    "op13_spelling_variants": variants.query,
}

ORACLES: dict[str, str] = {
    "op1_secret_scan": secrets.oracle(),
    "op7_decontamination": decontaminate.ORACLE,
}
