"""tidemark: a PySpark library for market-news analytics and data processing."""
