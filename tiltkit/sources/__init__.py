"""Parquet/CSV sources and sinks, and option-like views over the test star schema."""

from .io import month_paths, read_months, read_panel, read_stock_daily, write_csv, write_panel

__all__ = ["month_paths", "read_months", "read_panel", "read_stock_daily", "write_csv", "write_panel"]
