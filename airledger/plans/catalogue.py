"""Every query of the registry engine by name, with its DuckDB SQL."""

from .registry_queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
