"""Queries of the corpus operators, for __spark_entry__.py."""

from __future__ import annotations

from . import fingerprints, language, licenses, mixing, pii, sentencepiece, sharding, simhash, vectors, warc

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_mixing": mixing.op2_mixing,
    "op3_fingerprints": fingerprints.op3_fingerprints,
    "op4_nearest": vectors.op4_nearest,
    "op5_sentencepiece": sentencepiece.op5_sentencepiece,
    "op6_warc": warc.op6_warc,
    "op7_licenses": licenses.op7_licenses,
    "op8_pii": pii.op8_pii,
    "op9_language": language.op9_language,
    "op10_simhash": simhash.op10_simhash,
}

#: Only archives can be said in SQL: the rest draws, estimates, learns, or hashes by functions that
#: SQL doesn't have, and is tested against brute force.
ORACLE_SQL: dict[str, str] = {"op6_warc": warc.ORACLE_SQL}
