"""Structured Streaming: incremental upserts and corpus statistics."""
