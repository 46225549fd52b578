"""Readers and writers of the corpus, vector, request and evaluation tables."""
