"""Scalar expressions of the dialect as Spark columns."""

from veldra.functions.lowering import Lowering, Typed

__all__ = ["Lowering", "Typed"]
