"""Queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from . import bpe, fingerprints, langid, line_dedup, neighbours, packing, sharding, simhash, token_files, warc

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_simhash": simhash.op2_simhash,
    "op3_byte_bpe": bpe.op3_byte_bpe,
    "op4_warc": warc.op4_warc,
    "op5_packing": packing.op5_packing,
    "op6_langid": langid.op6_langid,
    "op7_token_files": token_files.op7_token_files,
    "op8_neighbours": neighbours.op8_neighbours,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_fingerprints": fingerprints.op10_fingerprints,
}
ORACLES = {
    "op4_warc": warc.OP4_SQL,
    "op9_line_dedup": line_dedup.OP9_SQL,
}
