"""Queries and oracles of this subpackage for the driver."""

from cuebook.llm import queries as q
from cuebook.llm.oracles import ORACLES

QUERIES = {f.__name__: f for f in (q.op1_embedding_neardup, q.op2_language_id, q.op3_ngram_jaccard, q.op4_sentencepiece, q.op5_toxicity, q.op6_url_filters, q.op7_multi_index, q.op8_source_mix, q.op9_html_text, q.op10_license_scan, q.op11_sharding, q.op12_periodic_runs, q.op13_lexical_search)}

__all__ = ["ORACLES", "QUERIES"]
