"""Structured Streaming forms of the ledger and of ingest."""
