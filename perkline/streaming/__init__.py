"""Incremental ingestion with Structured Streaming (an extension; the batch layers do not need it)."""
