"""All registered queries: name -> (DataFrame builder, oracle SQL or None)."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "graph_queries", "contact_queries", "likelihood_queries", "distance_queries", "inference_queries", "training_queries",
    "region_queries",
)


def registered() -> dict:
    out: dict = {}
    for name in MODULES:
        for key, entry in import_module(f"walkweave.plans.{name}").QUERIES.items():
            if key in out:
                raise ValueError(f"query {key!r} registered twice")
            out[key] = entry
    return out
