"""Readers and writers: files, graph formats and SQL."""
