"""The queries of this subpackage, by the names under which they are registered."""

from __future__ import annotations

from . import audio, ctw, exact_dedup, fixity, language, minhash, packing, piece_codec, sharding, spelling, toxicity, url_rules, vector_codes

QUERIES = {
    "op1_minhash_dedup": minhash.query,
    "op2_audio_fingerprint": audio.query,
    "op3_context_tree_score": ctw.query,
    "op4_fixity_audit": fixity.query,
    "op5_balanced_shards": sharding.query,
    "op6_pack": packing.query,
    "op7_piece_codec": piece_codec.query,
    "op8_exact_dedup": exact_dedup.query,
    "op9_language_id": language.query,
    "op10_url_rules": url_rules.query,
    "op11_spelling_variants": spelling.query,
    "op12_vector_codes": vector_codes.query,
    "op13_toxicity": toxicity.query,
}

SQL: dict[str, str] = {
    "op4_fixity_audit": fixity.SQL,
    "op8_exact_dedup": exact_dedup.SQL,
    "op10_url_rules": url_rules.SQL,
    "op11_spelling_variants": spelling.SQL,
    "op12_vector_codes": vector_codes.SQL,
}
