"""Operations of a large-scale training-data pipeline."""

from convoylake.llm.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
