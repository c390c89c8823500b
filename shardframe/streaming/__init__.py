"""Structured Streaming operators on training events."""

from shardframe.streaming.gaps import stream_marker_latency
from shardframe.streaming.rates import latest, run_available, stream_latest_step, stream_miss_rate, stream_rate

__all__ = ["latest", "run_available", "stream_latest_step", "stream_marker_latency", "stream_miss_rate", "stream_rate"]
