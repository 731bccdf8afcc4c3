"""All queries of the core library."""

from __future__ import annotations

from functools import cache

from kilnwork.plans.registry import Registry


@cache
def registry() -> Registry:
    out = Registry()
    from kilnwork.plans import formats, graphs, packed, ratings, relational, similarity, streams

    for part in (relational, similarity, ratings, graphs, streams, packed, formats):
        part.register(out)
    return out
