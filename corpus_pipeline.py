"""The corpus pipeline by the names its caller knows; the stages are in ``slatecast.llm.pipeline``."""

from slatecast.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
