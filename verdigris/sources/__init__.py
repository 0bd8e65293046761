"""Readers and writers of catalog data."""
