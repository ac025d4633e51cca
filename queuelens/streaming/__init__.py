"""Structured Streaming jobs: document ingest, register events, alerts, ownership."""
