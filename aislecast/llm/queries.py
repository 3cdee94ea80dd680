"""Registered queries of the text operators and their check SQL."""

from __future__ import annotations

from . import bpe, collocations, linededup, mixing, ngrams, packing, pii, rotation, simhash, toxicity, turnrepair, vectors, winnowing

QUERIES = {
    "op1_line_dedup": linededup.op1_line_dedup,
    "op2_pii": pii.op2_pii,
    "op3_mixing": mixing.op3_mixing,
    "op4_bpe": bpe.op4_bpe,
    "op5_toxicity": toxicity.op5_toxicity,
    "op7_lm_scoring": ngrams.op7_lm_scoring,
    "op6_embedding_dedup": vectors.op6_embedding_dedup,
    "op8_chat_rotation": rotation.op8_chat_rotation,
    "op9_winnowing": winnowing.op9_winnowing,
    "op10_simhash": simhash.op10_simhash,
    "op11_turn_repair": turnrepair.op11_turn_repair,
    "op12_collocations": collocations.op12_collocations,
    "op13_packing": packing.op13_packing,
}
SQL = {
    "op1_line_dedup": linededup.SQL,
    "op2_pii": pii.SQL,
    "op3_mixing": mixing.SQL,
    "op6_embedding_dedup": vectors.SQL,
    "op8_chat_rotation": rotation.SQL,
    "op11_turn_repair": turnrepair.SQL,
    "op12_collocations": collocations.SQL,
}
