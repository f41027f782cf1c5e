"""Structured Streaming queries over payloads, fetch events, link checks, signals and clicks."""
