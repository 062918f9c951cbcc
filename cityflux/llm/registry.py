"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from . import op01_mixing, op02_jaccard, op03_matroska, op04_toxicity, op05_pieces, op06_pii, op07_sharding, op08_substrings, op09_quality, op10_chat, op11_negatives, op12_repair, op13_contamination

QUERIES = {
    "op1_mixing": op01_mixing.query,
    "op2_jaccard": op02_jaccard.query,
    "op2_links": op02_jaccard.links_query,
    "op3_matroska": op03_matroska.query,
    "op4_toxicity": op04_toxicity.query,
    "op5_pieces": op05_pieces.query,
    "op6_pii": op06_pii.query,
    "op7_sharding": op07_sharding.query,
    "op8_substrings": op08_substrings.query,
    "op9_quality": op09_quality.query,
    "op10_chat": op10_chat.query,
    "op11_negatives": op11_negatives.query,
    "op12_repair": op12_repair.query,
    "op13_contamination": op13_contamination.query,
}
ORACLES = {
    "op1_mixing": op01_mixing.ORACLE,
    "op2_jaccard": op02_jaccard.ORACLE,
    "op2_links": op02_jaccard.LINKS_ORACLE,
    "op7_sharding": op07_sharding.ORACLE,
    "op8_substrings": op08_substrings.ORACLE,
    "op9_quality": op09_quality.ORACLE,
    "op10_chat": op10_chat.ORACLE,
    "op11_negatives": op11_negatives.ORACLE,
    "op12_repair": op12_repair.ORACLE,
    "op13_contamination": op13_contamination.ORACLE,
}
