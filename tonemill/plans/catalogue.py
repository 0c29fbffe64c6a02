"""All registered queries and their oracles."""

from tonemill.plans import queries_ingest, queries_models, queries_streams, queries_text, queries_vectors  # noqa: F401
from tonemill.plans.fixtures import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
