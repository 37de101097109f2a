"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import decontamination, exact_dedup, language, mixing, prefix_trie, pseudonyms, repair, scoring, secrets, simhash, token_counts, token_files, url_rules

QUERIES = {
    "op1_mixing": mixing.query,
    "op2_token_counts": token_counts.query,
    "op3_simhash": simhash.query,
    "op4_language": language.query,
    "op5_pseudonyms": pseudonyms.query,
    "op6_decontamination": decontamination.query,
    "op7_exact_dedup": exact_dedup.query,
    "op8_url_rules": url_rules.query,
    "op9_scoring": scoring.query,
    "op10_token_files": token_files.query,
    "op11_prefix_trie": prefix_trie.query,
    "op12_secrets": secrets.query,
    "op13_repair": repair.query,
}
ORACLES = {
    "op1_mixing": mixing.ORACLE,
    "op6_decontamination": decontamination.ORACLE,
    "op7_exact_dedup": exact_dedup.ORACLE,
    "op8_url_rules": url_rules.ORACLE,
}
