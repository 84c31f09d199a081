"""Names of the analytics queries, their functions and their oracle SQL."""

from __future__ import annotations

import importlib

_MODULES = ("operators.usage", "operators.simulate", "operators.sweep", "operators.metrics", "operators.resampling", "operators.text", "operators.splits", "operators.conversations", "operators.workspace", "operators.datasets", "operators.contracts", "operators.chatlog", "operators.documents", "ml.routers", "ml.train", "ml.evaluation")
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in _MODULES:
    _module = importlib.import_module(f"routelens.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
