"""Structured Streaming forms of the windowed and stitching operators."""
