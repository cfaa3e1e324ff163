"""Imports every operator module, so that its queries are registered."""

from donorlift.llm import bpe, decontam, langid, licences, mixing, ngram_join, packing, topk, toxicity, turns, urls, warc, whitening  # noqa: F401
from donorlift.llm.queries import QUERIES, SQL  # noqa: F401
