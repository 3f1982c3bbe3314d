"""The corpus pipeline, for callers that look for it here; its stages are in ``wayfold.llm.pipeline``."""

from wayfold.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
