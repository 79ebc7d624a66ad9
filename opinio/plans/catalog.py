"""Loads every query module; the registry then holds all queries."""

from __future__ import annotations

from . import q_clean, q_features, q_flows, q_labels, q_profile, q_topics  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
