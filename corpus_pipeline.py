"""The corpus pipeline: STAGES, run() and ORACLE_SQL, defined in loomcat.llm.pipeline."""

from loomcat.llm.pipeline import ORACLE_SQL, STAGES, run  # noqa: F401
