"""Readers of logs, files and texts, and writers of tables."""
