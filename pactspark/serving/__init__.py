"""Serving results: formats, cache, worker pool."""
