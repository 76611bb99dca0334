"""The registered queries of this folder: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from facewave.llm.bpe import op9_bpe
from facewave.llm.html_text import op6_html_text
from facewave.llm.jaccard_join import op5_jaccard_join
from facewave.llm.kd_shards import op8_kd_shards
from facewave.llm.langid import op10_langid
from facewave.llm.lm_score import op3_lm_score
from facewave.llm.oracle import ORACLE_SQL
from facewave.llm.periodic_runs import op11_periodic_runs
from facewave.llm.prefix_trie import op12_prefix_trie
from facewave.llm.quality_rules import op13_compression_bands
from facewave.llm.suffix_arrays import op1_suffix_arrays
from facewave.llm.toxicity import op4_toxicity
from facewave.llm.vp_search import op2_vp_search
from facewave.llm.warc import op7_warc

QUERIES = {
    "op1_suffix_arrays": op1_suffix_arrays,
    "op2_vp_search": op2_vp_search,
    "op3_lm_score": op3_lm_score,
    "op4_toxicity": op4_toxicity,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_html_text": op6_html_text,
    "op7_warc": op7_warc,
    "op8_kd_shards": op8_kd_shards,
    "op9_bpe": op9_bpe,
    "op10_langid": op10_langid,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_compression_bands": op13_compression_bands,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
