"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from askwell.llm.bpe import op6_bpe
from askwell.llm.fingerprints import op4_fingerprints
from askwell.llm.media import op8_media
from askwell.llm.packing import op10_packing
from askwell.llm.pii import op3_pii
from askwell.llm.quality import op1_quality
from askwell.llm.repeats import op9_repeats
from askwell.llm.simhash import op7_simhash
from askwell.llm.toxicity import op5_toxicity
from askwell.llm.urls import op2_urls

QUERIES = {
    "op1_quality": op1_quality,
    "op2_urls": op2_urls,
    "op3_pii": op3_pii,
    "op4_fingerprints": op4_fingerprints,
    "op5_toxicity": op5_toxicity,
    "op6_bpe": op6_bpe,
    "op7_simhash": op7_simhash,
    "op8_media": op8_media,
    "op9_repeats": op9_repeats,
    "op10_packing": op10_packing,
}

ORACLES: dict[str, str] = {}
