"""The queries of the numbered operators, and SQL for those that SQL can express."""

from __future__ import annotations

from hubloom.llm import (
    ann, chat, lexical, licenses, minhash, mixing, neargraph, periodic, pii, quality, segmentations, sharding, toxicity)

QUERIES = {
    "op1_neargraph": neargraph.op1_neargraph,
    "op2_licenses": licenses.op2_licenses,
    "op3_minhash": minhash.op3_minhash,
    "op5_ann": ann.op5_ann,
    "op6_mixing": mixing.op6_mixing,
    "op4_quality": quality.op4_quality,
    "op7_segmentations": segmentations.op7_segmentations,
    "op8_pii": pii.op8_pii,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_sharding": sharding.op10_sharding,
    "op11_lexical": lexical.op11_lexical,
    "op12_prefix_targets": chat.op12_prefix_targets,
    "op13_periodic": periodic.op13_periodic,
}

ORACLES = {
    "op3_minhash": minhash.OP3_SQL,
    "op6_mixing": mixing.OP6_SQL,
    "op11_lexical": lexical.OP11_SQL,
    "op12_prefix_targets": chat.OP12_SQL,
}
