"""Structured Streaming: record consumer, dedupe, velocity state, snapshot upserts."""
