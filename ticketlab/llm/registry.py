"""Queries of the training-data operators, for ``__spark_entry__.py``."""

from __future__ import annotations

import corpus_pipeline

from . import ann, decontam, langid, lm, merkle, minhash, packing, phrases, quality, sentencepieces, sharding, toxicity, warc

QUERIES = {
    "op1_minhash": minhash.op1_minhash,
    "op2_mil": toxicity.op2_mil,
    "op3_attention": lm.op3_attention,
    "op4_warc": warc.op4_warc,
    "op5_gam": quality.op5_gam,
    "op6_cutting_stock": packing.op6_cutting_stock,
    "op7_codes": ann.op7_codes,
    "op8_rendezvous": sharding.op8_rendezvous,
    "op9_viterbi": langid.op9_viterbi,
    "op10_templates": decontam.op10_templates,
    "op11_merkle": merkle.op11_merkle,
    "op12_sentencepiece": sentencepieces.op12_sentencepiece,
    "op13_phrases": phrases.op13_phrases,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL = {
    "op1_minhash": minhash.ORACLE_SQL,
    "op4_warc": warc.ORACLE_SQL,
    "op10_templates": decontam.ORACLE_SQL,
    "op11_merkle": merkle.ORACLE_SQL,
    "op13_phrases": phrases.ORACLE_SQL,
}
