from .ingest import export_stream, run_weekly, unified_stream, weekly_stream  # noqa: F401
