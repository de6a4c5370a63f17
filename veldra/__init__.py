"""A PySpark-native relational query layer with a small, strictly typed SQL dialect."""

from veldra.engine import Engine, Result
from veldra.errors import AnalysisError, CatalogError, EngineError, ParseError

__all__ = ["AnalysisError", "CatalogError", "Engine", "EngineError", "ParseError", "Result"]
