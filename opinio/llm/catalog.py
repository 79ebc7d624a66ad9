"""Loads the operators; the registry then holds their queries."""

from __future__ import annotations

from . import (  # noqa: F401
    embedding_dedup, exact_dedup, hard_negatives, hmm, line_dedup, mixing, near_dedup, packing, pii, quality, sharding, token_output, whitening,
)
from .registry import ORACLES, QUERIES  # noqa: F401
