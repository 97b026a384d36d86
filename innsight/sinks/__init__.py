"""Sinks: CSV export with the application's CSV conventions, and Parquet marts."""
