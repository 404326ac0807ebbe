"""Registry of the corpus queries."""

from __future__ import annotations

import corpus_pipeline

from . import ann, decontam, pii, secrets, simhash, sp_codec, suffix_dedup, token_store, toxicity, url_filter

MODULES = (simhash, ann, pii, suffix_dedup, token_store, decontam, url_filter, sp_codec, toxicity, secrets)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracles() -> dict[str, str]:
    found = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
