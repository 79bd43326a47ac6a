"""All queries of the subpackage and their SQL, by name."""

from __future__ import annotations

from barline.llm import queries_lm, queries_map, queries_native, queries_pairs, queries_words

QUERIES = {**queries_map.QUERIES, **queries_native.QUERIES, **queries_pairs.QUERIES, **queries_lm.QUERIES, **queries_words.QUERIES}
ORACLES = {**queries_map.ORACLES, **queries_native.ORACLES, **queries_pairs.ORACLES, **queries_lm.ORACLES, **queries_words.ORACLES}
