"""The registered queries of this package and their SQL, and the pipeline's."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline

from . import conversations, decontaminate, jaccard, langid, mixing, pii, sharding, tokencounts, topk, toxicity, urlfilter, warc

_MODULES = (warc, tokencounts, pii, decontaminate, urlfilter, mixing, topk, jaccard, langid, toxicity, conversations, sharding)


def queries() -> dict[str, Callable]:
    found = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    found = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
