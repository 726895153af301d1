"""Structured Streaming forms of feedback averages, memory upserts and event checks."""
