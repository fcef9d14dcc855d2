"""Scans and sinks: crawl tables, media trees, manifests, index snapshots, reports."""

from threadlake.sources.tables import read_table, read_pages

__all__ = ["read_table", "read_pages"]
