"""The registered queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

import corpus_pipeline
from auditframe.llm import ball_tree, bpe, imatch, jaccard, langmodel, line_chunks, packing, phrases, quality, simhash, toxicity, turns, warc

_MODULES = (warc, quality, toxicity, jaccard, imatch, ball_tree, bpe, langmodel, packing, line_chunks, simhash, phrases, turns)

QUERIES = {name: fn for m in _MODULES for name, fn in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
