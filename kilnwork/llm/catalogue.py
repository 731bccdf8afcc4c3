"""All queries of this subpackage."""

from __future__ import annotations

from functools import cache

from kilnwork.plans.registry import Registry


@cache
def registry() -> Registry:
    out = Registry()
    from kilnwork.llm import cooccurrence_queries, distinctive_queries, frequency_queries, heavy_queries, packing_queries, personal_queries, setjoin_queries, topn_queries

    parts = (cooccurrence_queries, topn_queries, distinctive_queries, heavy_queries, frequency_queries, setjoin_queries, packing_queries, personal_queries)

    for part in parts:
        part.register(out)
    return out
