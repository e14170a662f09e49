"""The subpackage's queries and their SQL, for the entry file."""

from __future__ import annotations

from . import alignment, chat, decontamination, embeddings, licenses, mixing, neardup, packing, repeats, search, sharding, toxicity, whitening

QUERIES = {
    "op1_bm25": search.op1_bm25,
    "op3_licenses": licenses.op3_licenses,
    "op2_toxicity": toxicity.op2_toxicity,
    "op5_repeats": repeats.op5_repeats,
    "op4_embeddings": embeddings.op4_embeddings,
    "op7_minhash": neardup.op7_minhash,
    "op6_pack": packing.op6_pack,
    "op8_mix": mixing.op8_mix,
    "op9_shard": sharding.op9_shard,
    "op10_chat": chat.op10_chat,
    "op11_align": alignment.op11_align,
    "op12_decontaminate": decontamination.op12_decontaminate,
    "op13_whiten": whitening.op13_whiten,
}

SQL = {
    "op1_bm25": search.OP1_SQL,
    "op3_licenses": licenses.OP3_SQL,
    "op4_embeddings": embeddings.OP4_SQL,
    "op5_repeats": repeats.OP5_SQL,
    "op7_minhash": neardup.OP7_SQL,
    "op8_mix": mixing.OP8_SQL,
    "op9_shard": sharding.OP9_SQL,
    "op10_chat": chat.OP10_SQL,
    "op12_decontaminate": decontamination.OP12_SQL,
}
