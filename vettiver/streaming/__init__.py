"""Transcript events of speech sessions, as tables and as streams."""
