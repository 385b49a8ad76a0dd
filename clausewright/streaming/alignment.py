"""Streaming alignment, an extension: agreements are aligned as they arrive.

Alignment is one stateless select, so the batch operator serves a stream as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.align import align


def align_stream(contexts: DataFrame, rules: list[dict], out: str, checkpoint: str, run_id: str = "stream") -> StreamingQuery:
    """Appends findings to Parquet; the checkpoint makes a restart go on where it stopped."""
    found = align(contexts, rules, run_id=run_id)
    return found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def tally_stream(findings: DataFrame, time_col: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Findings per window, severity and outcome; later ones than ``late`` are left out."""
    from pyspark.sql import functions as F

    return findings.withWatermark(time_col, late).groupBy(F.window(time_col, window), "severity", "outcome").agg(F.count("*").alias("n"))
