"""The pipeline of scenelake.llm.pipeline under the name that callers expect at the top of the repository."""

from scenelake.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
