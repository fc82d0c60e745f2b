"""Readers: folders, lists, change logs, journals, documents, configuration."""
