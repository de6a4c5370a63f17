"""The dialect's SELECT over streams: filters and projections are stateless, and joins with a
table are stream-static joins, so the same plan runs in every micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from veldra.engine import Engine
from veldra.errors import AnalysisError


def stream(engine: Engine, text: str) -> DataFrame:
    """The streaming frame of a SELECT whose tables include a registered streaming DataFrame."""
    result = engine.sql(text)
    if not result.success:
        raise AnalysisError(result.message)
    if result.frame is None or not result.frame.isStreaming:
        raise AnalysisError("The statement reads no stream")
    return result.frame


def write(engine: Engine, text: str, checkpoint: str, output_mode: str = "append") -> DataStreamWriter:
    """A writer to start, with its progress kept in ``checkpoint``."""
    return stream(engine, text).writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint)
