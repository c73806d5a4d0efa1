"""Structured Streaming ingestion of monthly option files."""

from .monthly import compact_stream_panel, month_stream, panel_stream, read_stream_panel

__all__ = ["compact_stream_panel", "month_stream", "panel_stream", "read_stream_panel"]
