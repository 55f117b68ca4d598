"""All queries of this package: importing this module registers them."""

from __future__ import annotations

from codeatlas.llm import queries_chat, queries_dedup, queries_models, queries_native, queries_runs, queries_vectors  # noqa: F401
from codeatlas.llm.registry import ORACLES, QUERIES  # noqa: F401
