"""Registered queries: each name has a Spark function and, where SQL can say it, the same query as SQL."""

from __future__ import annotations


def registry() -> dict:
    from catalog import cleaning, panels, roundtrips, studies, suspension

    merged = {}
    for module in (cleaning, panels, roundtrips, studies, suspension):
        merged.update(module.QUERIES)
    return merged
