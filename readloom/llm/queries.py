"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from readloom.llm import bitpack, chunk_dedup, conversations, exact_dedup, interpolation, jaccard, language, mixing, packing, quality, sharding, vector_codes, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_interpolation": interpolation.op2_interpolation,
    "op3_pack": packing.op3_pack,
    "op4_chunk_dedup": chunk_dedup.op4_chunk_dedup,
    "op5_quality": quality.op5_quality,
    "op6_language": language.op6_language,
    "op7_mix_sources": mixing.op7_mix_sources,
    "op8_jaccard": jaccard.op8_jaccard,
    "op9_token_ids": bitpack.op9_token_ids,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_conversations": conversations.op11_conversations,
    "op12_shard": sharding.op12_shard,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}
SQL = warc.SQL | mixing.SQL | exact_dedup.SQL | conversations.SQL | sharding.SQL | vector_codes.SQL
