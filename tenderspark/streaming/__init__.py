"""Structured Streaming: ingest loop, event log and resolution cycle."""
