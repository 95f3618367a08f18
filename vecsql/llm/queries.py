"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import images, licenses, mixing, near_dedup, packing, quality, secrets, suffix_tree, toxicity, vector_dedup

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_licenses": licenses.op2_licenses,
    "op3_mixing": mixing.op3_mixing,
    "op4_near_dedup": near_dedup.op4_near_dedup,
    "op5_vector_dedup": vector_dedup.op5_vector_dedup,
    "op6_packing": packing.op6_packing,
    "op7_secrets": secrets.op7_secrets,
    "op8_image_copies": images.op8_image_copies,
    "op9_suffix_tree": suffix_tree.op9_suffix_tree,
    "op10_toxicity": toxicity.op10_toxicity,
}

ORACLE_SQL = {
    "op2_licenses": licenses.oracle(),
    "op3_mixing": mixing.ORACLE,
    "op4_near_dedup": near_dedup.ORACLE,
    "op5_vector_dedup": vector_dedup.ORACLE,
}
