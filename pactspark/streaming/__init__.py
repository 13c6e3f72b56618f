"""Governed streams: row filters and masks are stateless and deterministic, so they hold for streams as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..errors import PactError
from ..operators.govern import GovernedFrame, approve
from ..policy import BundleHandle, ResolvedPolicy


def govern_stream(df: DataFrame, policy: ResolvedPolicy | BundleHandle, dataset: str = "stream", null_mode: str = "typed") -> GovernedFrame:
    """Approve, filter and mask a streaming frame. A policy with noise is refused: each micro-batch would have to pay for it."""
    frame = approve(df, policy, dataset)
    if not df.isStreaming:
        raise PactError("govern_stream is for streams; use govern")
    if frame.policy.dp_columns:
        raise PactError("noise on a stream is not supported")
    return frame.row_filter().mask(null_mode)
