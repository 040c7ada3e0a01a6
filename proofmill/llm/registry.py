"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from proofmill.llm import language_id, mixing, near_dup, phrase_index, quality, sharding, token_file, toxicity, url_filter, warc

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_warc": warc.op2_warc,
    "op3_mixing": mixing.op3_mixing,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_language_id": language_id.op5_language_id,
    "op6_byte_shards": sharding.op6_byte_shards,
    "op7_quality": quality.op7_quality,
    "op8_near_dup": near_dup.op8_near_dup,
    "op9_phrase_index": phrase_index.op9_phrase_index,
    "op10_token_file": token_file.op10_token_file,
}
ORACLES = {
    "op1_url_filter": url_filter.OP1_SQL,
    "op2_warc": warc.OP2_SQL,
    "op3_mixing": mixing.OP3_SQL,
    "op6_byte_shards": sharding.OP6_SQL,
    "op9_phrase_index": phrase_index.OP9_SQL,
}
