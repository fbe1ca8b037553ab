"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from presswork.llm import codes, fingerprint, license, mix, pack, pll, quality, shard, simhash, topk, urlfilter, warc, whiten

QUERIES = {
    "op1_mix_sources": mix.op1_mix_sources,
    "op2_quality": quality.op2_quality,
    "op3_shard_bytes": shard.op3_shard_bytes,
    "op4_simhash_dedup": simhash.op4_simhash_dedup,
    "op5_lm_score": pll.op5_lm_score,
    "op6_top_k": topk.op6_top_k,
    "op7_url_filter": urlfilter.op7_url_filter,
    "op8_fingerprint": fingerprint.op8_fingerprint,
    "op9_license_scan": license.op9_license_scan,
    "op10_pack": pack.op10_pack,
    "op11_whitening": whiten.op11_whitening,
    "op12_warc": warc.op12_warc,
    "op13_vector_codes": codes.op13_vector_codes,
}
ORACLE = {
    "op1_mix_sources": mix.OP1_SQL,
    "op6_top_k": topk.OP6_SQL,
    "op7_url_filter": urlfilter.OP7_SQL,
    "op9_license_scan": license.OP9_SQL,
    "op12_warc": warc.OP12_SQL,
    "op13_vector_codes": codes.OP13_SQL,
}
