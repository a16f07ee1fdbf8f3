"""From raw documents to packed training sequences: the stages of ``tradelens.llm.pipeline``."""

from tradelens.llm.pipeline import COLUMNS, ORACLE_SQL, STAGES, benchmark_passages, near_duplicates, packed, quality_rules, repeated_passages, run

__all__ = ["COLUMNS", "ORACLE_SQL", "STAGES", "benchmark_passages", "near_duplicates", "packed", "quality_rules", "repeated_passages", "run"]
