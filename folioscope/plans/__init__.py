"""Queries over an archive: documents, observations, search, series."""
