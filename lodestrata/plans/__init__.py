"""Importing this package registers all queries."""

from . import build, graph, ingest, integrity, lifecycle, names, navigation, overview, reading, retrieval, series, streams, surface, watched  # noqa: F401
