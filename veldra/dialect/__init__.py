"""Text to statements, without Spark."""

from veldra.dialect.parser import parse

__all__ = ["parse"]
