"""Every registered query of the retrieval engine and its SQL twin."""

from importlib import import_module

from .base import ORACLE_SQL, QUERIES

for _name in ("ingestion", "guarding", "retrieval", "evidence", "grounding", "deciding", "evaluating", "asking", "remembering", "learning", "serving", "streaming"):
    import_module(f"querent.plans.{_name}")

__all__ = ["ORACLE_SQL", "QUERIES"]
