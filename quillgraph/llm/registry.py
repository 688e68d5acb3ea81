"""The operators' queries, by name, with SQL where SQL can express them."""

from __future__ import annotations

from quillgraph.llm import codes, decontam, langid, licenses, merkle, neardup, packing, pieces, secrets, shards, suffixes, surrogates, vectors

QUERIES = {
    "op6_shards": shards.query,
    "op3_neardup": neardup.query,
    "op1_suffixes": suffixes.query,
    "op7_licenses": licenses.query,
    "op5_surrogates": surrogates.query,
    "op9_vectors": vectors.query,
    "op2_langid": langid.query,
    "op8_packing": packing.query,
    "op4_secrets": secrets.query,
    "op10_decontam": decontam.query,
    "op11_merkle": merkle.query,
    "op12_pieces": pieces.query,
    "op13_codes": codes.query,
}

ORACLES = {
    "op1_suffixes": suffixes.ORACLE_SQL,
    "op4_secrets": secrets.ORACLE_SQL,
    "op9_vectors": vectors.ORACLE_SQL,
    "op10_decontam": decontam.ORACLE_SQL,
    "op11_merkle": merkle.ORACLE_SQL,
    "op13_codes": codes.ORACLE_SQL,
}
