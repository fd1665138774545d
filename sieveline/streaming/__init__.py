"""Structured Streaming versions: windowed counts with watermarks and incremental centroids."""
