"""Structured Streaming jobs: ingest, normalise, store, alert."""
