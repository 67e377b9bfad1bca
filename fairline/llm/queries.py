"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

import corpus_pipeline
from fairline.llm import op1_decontaminate, op2_urls, op3_jaccard, op4_secrets, op5_toxicity, op6_pieces, op7_embeddings, op8_warc, op9_licenses, op10_language, op11_personal, op12_alignment, op13_manifest

QUERIES = {
    "op1_decontaminate": op1_decontaminate.op1_decontaminate,
    "op2_host_reputation": op2_urls.op2_host_reputation,
    "op3_ngram_jaccard": op3_jaccard.op3_ngram_jaccard,
    "op4_secrets": op4_secrets.op4_secrets,
    "op5_toxicity": op5_toxicity.op5_toxicity,
    "op6_sentencepiece": op6_pieces.op6_sentencepiece,
    "op7_embedding_dedup": op7_embeddings.op7_embedding_dedup,
    "op8_warc": op8_warc.op8_warc,
    "op9_licenses": op9_licenses.op9_licenses,
    "pipeline": corpus_pipeline.run,
    "op10_language_id": op10_language.op10_language_id,
    "op11_personal_data": op11_personal.op11_personal_data,
    "op12_alignment": op12_alignment.op12_alignment,
    "op13_merkle_manifest": op13_manifest.op13_merkle_manifest,
}
ORACLES = {"op2_host_reputation": op2_urls.ORACLE_SQL, "op7_embedding_dedup": op7_embeddings.ORACLE_SQL, "op1_decontaminate": op1_decontaminate.ORACLE_SQL, "op3_ngram_jaccard": op3_jaccard.ORACLE_SQL, "op4_secrets": op4_secrets.ORACLE_SQL, "op8_warc": op8_warc.ORACLE_SQL, "op11_personal_data": op11_personal.ORACLE_SQL, "op13_merkle_manifest": op13_manifest.ORACLE_SQL}
