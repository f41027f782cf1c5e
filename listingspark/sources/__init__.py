"""Landed payloads, source registry and table sinks."""
