"""Errors that a statement may end with; an Engine turns them into failed results."""


class EngineError(Exception):
    """Base of all."""


class ParseError(EngineError):
    """The text isn't a statement of the dialect."""


class AnalysisError(EngineError):
    """Names or types don't fit."""


class CatalogError(EngineError):
    """Tables or indexes are missing or in the way."""


class ExecutionError(EngineError):
    """A row made an expression fail, as a division by zero does."""
