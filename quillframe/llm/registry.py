"""The subpackage's queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import chat_transcripts, curve_packing, exact_dedup, hashed_classifier, label_sharding, mixing, near_dedup, rule_ensemble, secrets, warc

QUERIES = {
    "op1_secret_scan": secrets.opquery,
    "op2_minhash_near_dedup": near_dedup.opquery,
    "op3_curve_packing": curve_packing.opquery,
    "op4_chat_transcripts": chat_transcripts.opquery,
    "op5_rule_ensemble": rule_ensemble.opquery,
    "op6_hashed_quality": hashed_classifier.opquery,
    "op7_label_sharding": label_sharding.opquery,
    "op8_source_mixing": mixing.opquery,
    "op9_warc_reader": warc.opquery,
    "op10_exact_dedup": exact_dedup.opquery,
}

SQL = {
    "op8_source_mixing": mixing.SQL,
    "op9_warc_reader": warc.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
}
