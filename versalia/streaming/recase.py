"""Recasing of a stream. Texts don't depend on each other, so there is no state and no watermark: a stream goes through the same pass as a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators.recase import recase
from ..options import CaseOptions


def start_recasing(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, options: CaseOptions = CaseOptions(), key: str = "doc_id", text: str = "text"):
    """Recase ``stream`` and hand ``(recased, batch id)`` of each micro-batch to ``sink``; where the texts go
    to a format that streams, ``recase(stream).writeStream`` needs no such function."""
    return recase(stream, options, key, text).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).start()
