"""Readers, writers and the cloud store."""
