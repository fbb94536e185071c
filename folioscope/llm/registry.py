"""Imports every operator, which registers its query."""

from folioscope.llm import bpe, chat, contamination, exact, lexical, licenses, near, phrases, pii, substring, suffix_tree, toxicity, wavelet  # noqa: F401
from folioscope.llm.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
