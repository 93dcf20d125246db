"""Readers of feeds, pages, documents and logs, and sinks."""
