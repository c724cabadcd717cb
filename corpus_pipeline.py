"""The corpus pipeline: STAGES, run and ORACLE_SQL of linewright.llm.stages, where its stages are."""

from linewright.llm.stages import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
