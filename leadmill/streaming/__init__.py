"""Streaming forms of the log and page operators."""
