"""Readers and writers of documents and records."""
